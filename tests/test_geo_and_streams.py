import datetime as dt
import math
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from fieldledger.functions.directions import claims_in, direction_claims
from fieldledger.operators import geo as G, ranking, series as S
from fieldledger.operators.ingest import upsert_latest
from fieldledger.streaming import incremental as I, log as L


def test_claims(spark):
    def got(text):
        found = spark.createDataFrame([(text,)], "t string").select(claims_in(F.col("t")).alias("c")).first()["c"]
        return [(c["city"], round(c["miles"], 1), c["bearing"], c["from_time"]) for c in found]

    assert got("68 miles from Dallas") == [("dallas", 68.0, None, False)]
    assert got("10 miles east of Bonham 70 miles NNE of Dallas") == [("bonham", 10.0, 90.0, False), ("dallas", 70.0, 22.5, False)]
    assert got("2 hours NE of Downtown Houston. 3.5 from downtown Dallas. 30 miles east of College Station") == [
        ("houston", 110.0, 45.0, True), ("dallas", 192.5, None, True), ("college station", 30.0, 90.0, False)]
    assert got("14 miles, around 24 minutes from Tyler") == [("tyler", 14.0, None, False)]
    assert got("North of Beaumont, approximately 14 miles") == [("beaumont", 14.0, 0.0, False)]
    assert got("North of Beaumont. Then 14 miles") == []
    assert got("an hour and 30 minutes from OKC") == [("oklahoma city", 82.5, None, True)]
    assert got("3 from Dallas") == [] and got("no city 30 miles") == []
    assert got("20 miles north of Waco and 35 minutes from Tyler, east of Paris 9 miles") == [
        ("waco", 20.0, 0.0, False), ("tyler", 32.1, None, True), ("paris", 9.0, 90.0, False)]
    assert got("12 miles. 2 hours from Austin") == [("austin", 12.0, None, False)]


def test_claims_reach_to_the_end_of_the_directions(spark):
    page = "<p>General Directions</p>" + "Take the gravel road by the dam. " * 40 + "11 miles south of Athens. Fishing Report 5 miles from Waco"
    rows = direction_claims(spark.createDataFrame([(1, page)], "k int, html string"), "k").collect()
    assert [(r["city"], r["miles"], r["bearing"]) for r in rows] == [("athens", 11.0, 180.0)]


def test_wrong_bearing_is_the_wrong_place(spark):
    points = spark.createDataFrame([("near", 33.3, -96.8), ("south", 32.2, -96.8), ("far", 29.0, -100.0), ("none", 32.0, -96.0)], "unit string, lat double, lon double")
    claims = spark.createDataFrame([(u, "dallas", 36.0, 0.0, False) for u in ("near", "south", "far")], "unit string, city string, miles double, bearing double, from_time boolean")
    miss = {r["unit"]: r["miss"] for r in G.geo_score(points, claims, ["unit"], ["unit"]).collect()}
    assert miss["near"] == 0.0 and miss["south"] > 15 and miss["far"] > 200 and "none" not in miss
    units = points.withColumns({"geo_uncertain": F.lit(False)})
    confirmed = spark.createDataFrame([("far",)], "unit string")
    verdict = {r["unit"]: r["verdict"] for r in G.geo_verify(units, claims, confirmed).collect()}
    assert verdict == {"near": "ok", "south": "suspect", "far": "settled", "none": "no claim"}


def test_nearest_anchor_is_exact(spark):
    rng = random.Random(8)
    anchors = [(rng.uniform(26, 37), rng.uniform(-103, -94)) for _ in range(80)] * 2
    points = [(i, rng.uniform(25, 38), rng.uniform(-105, -93)) for i in range(60)]

    def miles(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(h))

    got = {r["k"]: r["near"] for r in G.nearest_anchor(spark.createDataFrame(points, "k int, lat double, lon double"),
                                                       spark.createDataFrame(anchors, "lat double, lon double"), ["k"]).collect()}
    for k, a, b in points:
        assert got[k] == pytest.approx(min(miles(a, b, c, d) for c, d in anchors), rel=1e-9)


def test_row_numbers_of_large_groups(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 3), i) for i, g in enumerate("aaaaaaaabb" * 20)]
    df = spark.createDataFrame(rows, "g string, c int, i int")
    got = {r["i"]: r["rn"] for r in ranking.row_number_by(df, ["g"], ["c"], ["i"], "rn").collect()}
    for g in "ab":
        for n, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])), 1):
            assert got[r[2]] == n


def test_intervals(spark):
    rows = [("c", "maxTemperature", "2026-05-01T22:00:00-05:00/PT4H", 30.0, 1), ("c", "quantitativePrecipitation", "2026-05-01T06:00:00+00:00/P1DT6H", 25.4, 2),
            ("c", "windDirection", "2026-05-01T00:00:00+00:00/PT1H", 10.0, 3), ("c", "windDirection", "2026-05-01T01:00:00+00:00/PT3H", 20.0, 4), ("c", "windDirection", "2026-05-01T04:00:00+00:00", 99.0, 5)]
    df = spark.createDataFrame(rows, "cell string, field string, valid_time string, value double, seq int")
    out = {str(r["day"]): r for r in S.interval_daily_columns(S.interval_expand_daily(df)).collect()}
    assert set(out) == {"2026-05-01", "2026-05-02"}
    first = out["2026-05-01"]
    assert first["temp_max_f"] == 86.0 and first["precip_in"] == pytest.approx(18.0) and first["wind_dir_deg"] == 20.0
    spread = {str(r["day"]): r["precip_in"] for r in S.interval_daily_columns(S.interval_expand_daily(df, spread=True)).collect()}
    assert spread["2026-05-01"] == pytest.approx(18 / 30) and spread["2026-05-02"] == pytest.approx(12 / 30)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Events over three files that arrive one per micro-batch, with a late rewrite."""
    folder = str(tmp_path_factory.mktemp("events"))
    base = dt.datetime(2024, 1, 1)
    for f in range(3):
        rows = [(f * 40 + i, base + dt.timedelta(hours=f * 40 + i), i % 5, "ab"[i % 2], float(i)) for i in range(40)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, kind string, value double").coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return I.arriving(spark, folder, schema, files_per_batch=1)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_stream_latest_equals_batch(spark, files):
    got = I.stream_ingest_latest(stream(spark, files), ["user_id"], ["ts"], I.workspace(spark, "t"))
    want = upsert_latest(spark.read.parquet(files), ["user_id"], ["ts"])
    assert as_set(got.select(*want.columns)) == as_set(want)


def test_stream_days_equal_batch_days(spark, files):
    got = as_set(I.stream_daily_conditions(stream(spark, files), "ts", ["kind"], I.workspace(spark, "t"), late="1 hour"))
    batch = as_set(I.daily_stats(spark.read.parquet(files), "ts", ["kind"]))
    assert got == batch and max(r[0] for r in got) > dt.date(2024, 1, 4)


def test_stream_coverage_equals_batch(spark, files):
    dims = {"b": F.col("kind") == "b", "big": F.col("value") > 20}
    got = I.stream_coverage(stream(spark, files), "ts", dims, I.workspace(spark, "t"), late="30 days")
    assert as_set(got) == as_set(I.coverage_counts(spark.read.parquet(files), "ts", dims))


def test_stream_dedupe(spark, files):
    twice = stream(spark, files).withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("c")
    got = I.stream_dedupe(twice, "ts", ["event_id"], I.workspace(spark, "t"))
    assert got.count() == 120 and got.select("event_id").distinct().count() == 120


def test_layout_of_the_log():
    """Segments cover all batches once; a batch leaves all earlier segments as they are or folds the last ones."""
    for fan in (2, 3, 8):
        for n in range(200):
            now, later = L.layout(n, fan), L.layout(n + 1, fan)
            assert [a for a, _ in now] == [0, *(b for _, b in now)][:len(now)] and (not now or now[-1][1] == n)
            assert later[:-1] == now[:len(later) - 1]
            sizes = [b - a for a, b in now]
            assert all(sizes.count(x) < fan for x in sizes)


def _parts(spark, k):
    return spark.createDataFrame([(i, k, f"{k}/{i}") for i in (k, k % 3, 100)], "id long, at long, v string")


def test_log_replays_restarts_and_folds(spark, tmp_path):
    """Every batch is given twice, and once after a failure before its commit; the log stays that of the batch twin."""
    schema = _parts(spark, 0).schema
    log = L.UpdateLog(str(tmp_path / "log"), schema, ["id"], ["at"], fan=3)
    assert log.batches(spark) == 0 and log.latest(spark).count() == 0

    class Lost(L.UpdateLog):
        def _commit(self, spark, batches):
            raise RuntimeError("lost before the commit")
    seen = []
    for k in range(11):
        old = log.latest(spark)                             # begun before the batch, read after it
        want_old = {tuple(r) for r in upsert_latest(reduce(lambda a, b: a.union(b), seen), ["id"], ["at"]).select("id", "at", "v").collect()} if seen else set()
        with pytest.raises(RuntimeError):
            Lost(log.folder, schema, ["id"], ["at"], fan=3).append(_parts(spark, k), k)
        assert log.batches(spark) == k and as_set(log.latest(spark)) == want_old
        log.append(_parts(spark, k), k)
        log.append(_parts(spark, k), k)
        seen.append(_parts(spark, k))
        assert as_set(old) == want_old
    want = upsert_latest(reduce(lambda a, b: a.union(b), seen), ["id"], ["at"]).select("id", "at", "v")
    assert as_set(log.latest(spark)) == as_set(want)
    kept = {p.name for p in (tmp_path / "log" / "rows").iterdir()}
    assert kept == {f"{a}-{b}" for a, b in {*L.layout(10, 3), *L.layout(11, 3)}}
    assert len(list((tmp_path / "log" / "manifest").iterdir())) == 2
    with pytest.raises(ValueError):
        log.append(_parts(spark, 0), 40)


def test_stream_goes_on_after_a_restart(spark, files, tmp_path):
    """Two runs on one folder, the log folded at every second batch, and new files in between."""
    base = I.workspace(spark, "t")
    given, files = files, str(tmp_path / "events")
    spark.read.parquet(given).repartition(3).write.parquet(files)
    I.stream_ingest_latest(stream(spark, files), ["user_id"], ["ts"], base, fan=2)
    extra = spark.read.parquet(files).where("user_id = 2").selectExpr(
        "event_id + 1000 AS event_id", "ts + INTERVAL 90 DAYS AS ts", "user_id", "kind", "value")
    rows = [tuple(r) for r in extra.collect()]
    spark.createDataFrame(rows, extra.schema).coalesce(1).write.mode("append").parquet(files)
    got = I.stream_ingest_latest(stream(spark, files), ["user_id"], ["ts"], base, fan=2)
    want = upsert_latest(spark.read.parquet(files), ["user_id"], ["ts"])
    assert as_set(got.select(*want.columns)) == as_set(want) and got.where("event_id >= 1000").count() == 1


def test_nearest_anchor_over_the_pyramid(spark):
    """Against every pair: far points, points on an anchor, a dense cell, repeats and missing positions."""
    import random
    from math import asin, cos, radians, sin, sqrt
    from fieldledger.functions.geo import EARTH_MILES
    from fieldledger.operators import geo as G
    rng = random.Random(3)
    anchors = [(rng.uniform(25, 37), rng.uniform(-103, -93)) for _ in range(60)] + [(31.0, -97.0)] * 5
    anchors += [(32.5 + rng.random() / 200, -96.5 + rng.random() / 200) for _ in range(300)] + [(-33.0, 151.0)]
    points = [(i, rng.uniform(24, 38), rng.uniform(-104, -92)) for i in range(80)]
    points += [(900, 31.0, -97.0), (901, -40.0, 170.0), (902, 89.0, 10.0), (903, 32.5025, -96.4975), (904, 0.0, 0.0)]
    df = spark.createDataFrame([*points, (905, None, 1.0)], "id int, lat double, lon double")
    at = spark.createDataFrame([*anchors, (None, None)], "lat double, lon double")

    def miles(a, b, c, d):
        h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        return 2 * EARTH_MILES * asin(min(1, sqrt(h)))
    got = {r["id"]: r["near"] for r in G.nearest_anchor(df, at, ["id"]).collect()}
    assert got == {i: pytest.approx(min(miles(a, b, *x) for x in anchors), abs=1e-6) for i, a, b in points}
    assert G.nearest_anchor(df, at.limit(0), ["id"]).count() == 0


def miles(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1.0, math.sqrt(h)))


def joined_rows(plan) -> int:
    """Rows that came out of the joins of an executed plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return joined_rows(plan.plan())
    below = sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))
    return below + (plan.metrics().get("numOutputRows").get().value() if name.endswith("Join") else 0)


def test_points_that_lie_close_go_down_the_pyramid_together(spark):
    rng = random.Random(3)
    anchors = [(30 + rng.random() * 3, -97 + rng.random() * 3) for _ in range(900)]
    points = [(k, 31.501 + rng.random() / 100, -95.501 + rng.random() / 100) for k in range(300)]
    out = G.nearest_anchor(spark.createDataFrame(points, "id int, lat double, lon double"),
                           spark.createDataFrame(anchors, "lat double, lon double"), ["id"])
    got = {r["id"]: r["near"] for r in out.collect()}
    best = lambda y, x: min(miles(y, x, a, o) for a, o in anchors)
    assert all(abs(got[k] - best(y, x)) < 1e-6 for k, y, x in points) and len(got) == 300
    assert joined_rows(out._jdf.queryExecution().executedPlan()) < 300 * 30


def test_nearest_anchor_across_the_date_line(spark):
    points = [(1, 10.0, 179.9), (2, -60.0, -179.95), (3, float("nan"), 5.0), (4, None, 1.0)]
    anchors = [(10.0, -179.9), (11.0, 170.0), (-61.0, 179.99), (80.0, 0.0)]
    got = {r["id"]: r["near"] for r in G.nearest_anchor(spark.createDataFrame(points, "id int, lat double, lon double"),
           spark.createDataFrame(anchors, "lat double, lon double"), ["id"]).collect()}
    want = {k: min(miles(y, x, a, o) for a, o in anchors) for k, y, x in points[:2]}
    assert set(got) == {1, 2} and all(abs(got[k] - want[k]) < 1e-6 for k in want)
