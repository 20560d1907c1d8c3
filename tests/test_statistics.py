"""Estimators on seeded frames, against plain pandas/numpy recomputation."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldledger.functions import bands as B, dates
from fieldledger.functions.stats import support_case
from fieldledger.operators import effects as E, effort, lift, recommend as R, units as U

TRIPS = "obs_id long, unit string, rate double, year long, month long, season string, obs_date date, count_total double"


def trips_frame(spark, rows):
    pdf = pd.DataFrame(rows)
    for c, v in (("unit", "u"), ("year", 2020), ("month", 5), ("season", "spring"), ("count_total", None)):
        if c not in pdf:
            pdf[c] = v
    if "obs_date" not in pdf:
        pdf["obs_date"] = pd.Timestamp("2020-05-01").date()
    cols = ["obs_id", "unit", "rate", "year", "month", "season", "obs_date", "count_total"]
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf[cols].itertuples(index=False)], TRIPS)


def labels_frame(spark, pairs):
    return spark.createDataFrame(pairs, "obs_id long, category string")


def brute_effect(rows, labels, label, min_stratum=4):
    """The definition, written out for one label."""
    named = {}
    for o, c in labels:
        named.setdefault(o, set()).add(c)
    diffs, weights = [], []
    for s in range(6):
        used = [r["rate"] for r in rows if min(len(named.get(r["obs_id"], ())), 5) == s and label in named.get(r["obs_id"], ())]
        other = [r["rate"] for r in rows if min(len(named.get(r["obs_id"], ())), 5) == s and label not in named.get(r["obs_id"], ())]
        if len(used) < min_stratum or len(other) < min_stratum:
            continue
        var = np.var(used, ddof=1) / len(used) + np.var(other, ddof=1) / len(other)
        if not var > 0:
            continue
        diffs.append(np.mean(used) - np.mean(other))
        weights.append(1 / var)
    if not diffs:
        return None
    return float(np.dot(weights, diffs) / sum(weights)), math.sqrt(1 / sum(weights))


@pytest.fixture(scope="module")
def confounded():
    """Rates grow with the number of labels named; 'rider' appears on half of the
    richest stratum and does nothing by itself."""
    rng = np.random.default_rng(7)
    rows, labels, oid = [], [], 0
    for n_labels, level in ((1, 3.0), (2, 4.0), (3, 5.0)):
        for i in range(60):
            oid += 1
            rows.append({"obs_id": oid, "rate": float(rng.normal(level, 0.4)), "year": 2015 + i % 5})
            pool = ["a", "b", "c"][:n_labels]
            if n_labels == 3 and i % 2:
                pool[2] = "rider"
            labels += [(oid, x) for x in pool]
    return rows, labels


def test_effect_equals_the_definition(spark, confounded):
    rows, labels = confounded
    frame = E.strata_label_count(trips_frame(spark, rows), labels_frame(spark, labels))
    got = {r["label"]: (r["diff"], r["se"]) for r in E.effects(E.moments(frame, []), []).collect()}
    for label in ("a", "b", "c", "rider"):
        want = brute_effect(rows, labels, label)
        if want is None:
            assert label not in got
        else:
            assert got[label] == pytest.approx(want, rel=1e-9)


def test_matching_removes_the_confound(spark, confounded):
    rows, labels = confounded
    frame = E.strata_label_count(trips_frame(spark, rows), labels_frame(spark, labels))
    m = E.moments(frame, [])
    naive = E.usage(m, []).where("label = 'rider'").first()["naive_diff"]
    matched = E.effects(m, []).where("label = 'rider'").first()["diff"]
    assert naive > 1.0 and abs(matched) < naive / 2


def test_merging_moments_equals_one_pass(spark, confounded):
    rows, labels = confounded
    frame = E.strata_label_count(trips_frame(spark, rows), labels_frame(spark, labels))
    fine = E.merge_moments(E.moments(frame, ["year"]), ["stratum", "label"])
    direct = {(r["stratum"], r["label"]): (r["n"], r["mean"], r["m2"]) for r in E.moments(frame, []).collect()}
    for r in fine.collect():
        assert (r["n"], r["mean"], r["m2"]) == pytest.approx(direct[(r["stratum"], r["label"])], rel=1e-9, abs=1e-9)


def test_constant_rates_give_no_effect(spark):
    rows = [{"obs_id": i, "rate": 2.5} for i in range(40)]
    frame = E.strata_label_count(trips_frame(spark, rows), labels_frame(spark, [(i, "ab"[i % 2]) for i in range(40)]))
    assert E.effects(E.moments(frame, []), []).count() == 0
    ev = E.label_evidence(E.moments(frame, ["year"]), []).collect()
    assert {r["support"] for r in ev} == {"thin"} and all(r["diff"] is None for r in ev)


def test_sign_flipping_years_are_unstable(spark):
    rng = np.random.default_rng(3)
    rows, labels, oid = [], [], 0
    for k, year in enumerate(range(2011, 2019)):
        for i in range(40):
            oid += 1
            bump = (2.5 if k < 5 else -1.5) if i % 2 else 0.0
            rows.append({"obs_id": oid, "rate": float(rng.normal(5 + bump, 0.5)), "year": year})
            labels.append((oid, "flip" if i % 2 else "plain"))
    frame = E.strata_label_count(trips_frame(spark, rows), labels_frame(spark, labels))
    row = E.label_evidence(E.moments(frame, ["year"]), []).where("label = 'flip'").first()
    assert (row["support"], row["stable"], row["years"], row["years_agreeing"]) == ("unstable", False, 8, 5)


def test_one_year_never_demotes(spark):
    rng = np.random.default_rng(4)
    rows = [{"obs_id": i, "rate": float(rng.normal(5 + 2 * (i % 2), 0.5))} for i in range(120)]
    frame = E.strata_label_count(trips_frame(spark, rows), labels_frame(spark, [(i, "ab"[i % 2]) for i in range(120)]))
    row = E.label_evidence(E.moments(frame, ["year"]), []).where("label = 'b'").first()
    assert row["stable"] is None and row["support"] == "backed" and row["years"] == 1


def test_gates_and_empty_inputs(spark):
    few = [{"obs_id": i, "rate": float(i)} for i in range(11)]
    frame = E.strata_label_count(trips_frame(spark, few), labels_frame(spark, [(i, "a") for i in range(6)]))
    assert E.label_evidence(E.moments(frame, ["year"]), []).count() == 0
    none = E.strata_label_count(trips_frame(spark, few).limit(0), labels_frame(spark, [(1, "a")]))
    assert E.label_evidence(E.moments(none, ["year"]), []).count() == 0
    assert lift.label_lift(trips_frame(spark, few), labels_frame(spark, [(99, "a")])).count() == 0


def test_support_table(spark):
    cases = [((1.0, 0.2, 1.8, 20, None), "backed"), ((1.0, 0.2, 1.8, 13, None), "suggestive"), ((1.0, 0.2, 1.8, 7, None), "thin"),
             ((1.0, 0.2, 1.8, 20, False), "unstable"), ((-1.0, -1.8, -0.2, 20, None), "below"), ((-1.0, -1.8, -0.2, 20, False), "unstable"),
             ((0.5, -0.2, 1.2, 14, None), "suggestive"), ((0.5, -0.3, 1.2, 14, None), "unproven"), ((0.5, -0.2, 1.2, 8, None), "unproven"), ((1.0, 0.2, 1.8, 3, True), "thin")]
    df = spark.createDataFrame([(*c, want) for c, want in cases], "diff double, lo double, hi double, n int, stable boolean, want string")
    got = df.select("want", support_case(F.col("diff"), F.col("lo"), F.col("hi"), F.col("n"), 6, 12, 15, F.col("stable")).alias("got"))
    assert [r for r in got.collect() if r["want"] != r["got"]] == []


def test_half_split_with_ties_and_missing_dates(spark):
    rng = np.random.default_rng(1)
    rows = [{"obs_id": int(i), "unit": "abc"[i % 3 if i < 60 else 0], "rate": 1.0,
             "obs_date": None if i % 17 == 0 else pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=int(rng.integers(0, 4)))} for i in range(151)]
    got = {r["obs_id"]: r["half"] for r in E.half_split(trips_frame(spark, rows), ["unit"]).collect()}
    assert len(got) == len(rows)
    for u in "abc":
        mine = sorted((r for r in rows if r["unit"] == u), key=lambda r: (r["obs_date"] is None, r["obs_date"] or 0, r["obs_id"]))
        for i, r in enumerate(mine):
            assert got[r["obs_id"]] == ("early" if i < len(mine) // 2 else "late")


def test_split_half_finds_a_real_signal(spark):
    rng = np.random.default_rng(11)
    rows, labels, oid = [], [], 0
    for u in range(16):
        strength = (u - 8) * 0.5
        for i in range(90):
            oid += 1
            rows.append({"obs_id": oid, "unit": f"u{u}", "rate": float(rng.normal(6 + strength * (i % 2), 0.5)),
                         "obs_date": pd.Timestamp("2018-01-01").date() + pd.Timedelta(days=i)})
            labels.append((oid, "x" if i % 2 else "y"))
    halved = E.half_split(trips_frame(spark, rows), ["unit"])
    m = E.moments(E.strata_label_count(halved, labels_frame(spark, labels)), ["unit", "half"])
    out = E.split_half_summary(E.split_half(m)).first()
    assert out["cells"] == 32 and out["r"] > 0.9 and out["repeats"] is True
    few = E.split_half_summary(E.split_half(m.where("unit in ('u1', 'u2')"))).first()
    assert (few["cells"], few["r"], few["repeats"]) == (4, None, None)


def test_lift_puts_luck_below_evidence(spark):
    rows = [{"obs_id": i, "rate": 3.0 if i < 30 else 0.5} for i in range(60)] + [{"obs_id": 99, "rate": 20.0}]
    labels = [(i, "good" if i < 30 else "bad") for i in range(60)] + [(99, "lucky")]
    got = {r["category"]: r for r in lift.label_lift(trips_frame(spark, rows), labels_frame(spark, labels), min_n=1).collect()}
    assert got["lucky"]["raw_rate"] > got["good"]["raw_rate"] and got["lucky"]["lift_lb"] < got["good"]["lift_lb"]
    rates = np.array([r["rate"] for r in rows])
    want = max(0.0, (30 * 3.0 + 8 * rates.mean()) / 38 - rates.std() / math.sqrt(30))
    assert got["good"]["lower_rate"] == pytest.approx(want)


@pytest.mark.parametrize("n,full,hours,source", [(200, 24.0, 6.0, "measured"), (20, 24.0, 8.0, "fallback"), (200, 64.0, 8.0, "fallback"), (200, 8.0, 8.0, "fallback")])
def test_calibration(spark, n, full, hours, source):
    df = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, "AM").otherwise("PM")).otherwise("ALL_DAY").alias("slot"),
                                   F.when(F.col("id") % 2 == 0, 16.0).otherwise(full).alias("count_total"))
    row = effort.calibrate_effort(df).first()
    assert (row["all_day_hours"], row["source"]) == (hours, source)
    rated = effort.restate_rates(df, effort.calibrate_effort(df)).where("slot = 'ALL_DAY'").first()
    assert rated["rate"] == pytest.approx(full / hours)


def test_calibration_of_nothing(spark):
    empty = spark.createDataFrame([], "slot string, count_total double")
    assert effort.calibrate_effort(empty).first()["all_day_hours"] == 8.0


def test_expected_rate_rewards_evidence(spark):
    rng = np.random.default_rng(2)
    rows, oid = [], 0

    def add(unit, n, mean, month):
        nonlocal oid
        values = rng.normal(0, 1, n)
        values = (values - values.mean()) / (values.std() or 1) * 2 + mean
        for v in values:
            oid += 1
            rows.append({"obs_id": oid, "unit": unit, "rate": float(v), "year": 2020, "month": month})

    add("club", 300, 4.0, 5)
    for unit, n, month in (("thin", 5, 5), ("more", 40, 5), ("most", 200, 5), ("off", 40, 1), ("tiny", 2, 5)):
        add(unit, n, 8.0, month)
    got = {r["unit"]: r for r in R.expected_rate(trips_frame(spark, rows), 5, 2020).collect()}
    assert got["most"]["lower"] > got["more"]["lower"] > got["thin"]["lower"]
    assert got["thin"]["expected"] < got["more"]["expected"] < got["most"]["expected"]
    assert got["off"]["basis"] == "unit-year" and got["off"]["se"] > got["more"]["se"]
    assert got["tiny"]["expected"] is None and got["tiny"]["basis"] == "insufficient"


def test_months_are_circular_and_unknowns_cost_one(spark):
    df = spark.createDataFrame([(1, 1.0, 12, 70.0), (2, 1.0, 7, None), (3, 1.0, None, 70.0), (4, None, 1, 70.0)], "obs_id int, rate double, month int, temp_max_f double")
    got = {r["obs_id"]: r["similarity"] for r in R.similar_obs(df, {"month": 1, "temp_max_f": 60}).collect()}
    assert got == {1: 2.0, 2: 7.0, 3: None}


def test_bands(spark):
    values = [None, -1.0, 0.0, 0.1, 15.0, 15.1, 30.0, 30.5, 5000.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = df.select("i", B.size_band(F.col("v")).alias("size"), B.volatility_band(F.col("v")).alias("vol"), B.band_of(F.col("v"), [7, 15], B.WIND_NAMES).alias("first"),
                     B.cut_right(F.col("v"), B.ACRES_EDGES, B.ACRES_NAMES).alias("cut")).orderBy("i").collect()
    assert [r["size"] for r in rows] == [None, None, None, "small", "small", "mid", "mid", "large", "large"]
    assert [r["vol"] for r in rows][:5] == [None, "steady", "steady", "steady", "swingy"]
    assert [r["first"] for r in rows] == [None, "calm", "calm", "calm", "moderate", "windy", "windy", "windy", "windy"]
    assert [r["cut"] for r in rows] == [None, None, "small", "small", "medium", "medium", "medium", "large", "large"]


def test_calendar(spark):
    days = ["2026-05-15", "2026-05-16", "2026-05-17", "2026-03-07", "2026-03-08", "2026-10-31", "2026-11-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    rows = df.select(dates.next_saturday(F.col("d")).cast("string").alias("sat"), dates.us_dst(F.col("d")).alias("dst")).collect()
    assert [r["sat"] for r in rows][:3] == ["2026-05-16", "2026-05-23", "2026-05-23"]
    assert [r["dst"] for r in rows] == [True, True, True, False, True, True, False]


def test_consistency_against_pandas(spark):
    rng = np.random.default_rng(9)
    rows = [{"obs_id": i, "unit": "ab"[i % 2], "rate": float(rng.gamma(2, 2)), "count_total": float(rng.integers(0, 30))} for i in range(81)]
    pdf = pd.DataFrame(rows)
    for r in U.unit_consistency(trips_frame(spark, rows)).collect():
        g = pdf[pdf.unit == r["unit"]]
        assert r["median"] == pytest.approx(g.rate.median()) and r["cv"] == pytest.approx(g.rate.std(ddof=1) / g.rate.mean())
        assert r["worst_decile"] == pytest.approx(g.rate.quantile(0.1)) and r["bust_rate"] == pytest.approx(100 * (g.count_total <= 2).mean())


def test_share_below_without_one_big_sort(spark):
    values = [3.2, 3.2, 0.5, 7.9, 3.9, 12.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["p"] for r in U.below_share(df, "v", "p").collect()}
    known = [v for v in values if v is not None]
    assert got == {i: pytest.approx(100 * sum(x < v for x in known) / len(known)) for i, v in enumerate(values) if v is not None}


def test_presentation_plan(spark):
    from fieldledger.operators.profile import presentation_plan
    club = spark.createDataFrame([("a", "backed", 2.0, 90), ("b", "backed", 1.5, 80), ("c", "backed", 1.0, 70), ("d", "backed", 0.5, 70), ("e", "below", -1.0, 70),
                                  ("f", "below", -2.0, 70), ("g", "below", -3.0, 70), ("h", "unstable", 1.0, 70), ("i", "unproven", 0.1, 70)], "label string, support string, diff double, trips int")
    local = spark.createDataFrame([("u", "a", 0.7, 14)], "unit string, label string, diff double, trips int")
    rows = presentation_plan(club, local).orderBy("side", "rank").collect()
    assert [(r["side"], r["label"]) for r in rows] == [("avoid", "e"), ("avoid", "f"), ("unstable", "h"), ("use", "a"), ("use", "b"), ("use", "c")]
    assert [(r["unit"], r["here_trips"]) for r in rows if r["label"] == "a"] == [("u", 14)]


def test_ranks_of_any_group(spark):
    """Against plain Python, with a constant value, null keys and null values; the constant is spread over ranges."""
    from fieldledger.operators import ranking as K, units as U
    rows = [(None if i % 11 == 0 else f"k{i % 3}", 5.0 if i % 2 else float(i % 7), i) for i in range(600)]
    rows += [("k1", None, 1000 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(7)
    got = {r["id"]: r["n"] for r in K.row_number_by(df, ["k"], [F.col("v").asc_nulls_last()], [F.col("id")], "n").collect()}
    for key in {k for k, *_ in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    known = [r[1] for r in rows if r[1] is not None]
    for r in U.below_share(df, "v", "share").collect():
        assert r["share"] == pytest.approx(100 * sum(x < r["v"] for x in known) / len(known))
    one = spark.range(40_000).select(F.lit(1).alias("k"), F.lit(2.0).alias("v"), "id")
    spread = one.repartitionByRange(F.col("k"), F.col("v"), F.col("id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 2 * 40_000 / len(spread)
    numbered = K.row_number_by(one, ["k"], [F.col("v")], [F.col("id")], "n")
    assert numbered.where(F.col("n") != F.col("id") + 1).count() == 0 and numbered.count() == 40_000
    assert K.row_number_by(one.limit(0), ["k"], [F.col("v")], [], "n").count() == 0


def test_shared_facts_are_made_once(spark):
    from fieldledger.plans import testbed as T
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, None), (2, 2.5)], "obs_id long, rate double")
    with T.shared_facts():
        first = T.once("fact", "a", make)
        with T.shared_facts():
            assert T.once("fact", "a", make) is first
        T.once("fact", "b", make)
    assert len(made) == 2 and sorted(map(tuple, first.collect()), key=str) == [(1, None), (2, 2.5)]
    T.once("fact", "a", make)
    assert len(made) == 3


def test_halves_read_their_input_once(spark):
    """A costly input is settled before its ranges are sampled, dealt and counted."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k, "u", k % 7) for k in range(40)], "obs_id long, unit string, day int").coalesce(1)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    got = E.half_split(rows.mapInArrow(count, rows.schema), ["unit"], "day").collect()
    assert seen.value == 40
    early = {r["obs_id"] for r in got if r["half"] == "early"}
    assert early == set(sorted(range(40), key=lambda k: (k % 7, k))[:20])
