"""Rule tables: text in, value out. One job per table."""
import pytest
from pyspark.sql import functions as F

from fieldledger.functions import html as H, text as X, vocabulary as V
from fieldledger.operators import entities as N, phrases as P, rules, taxonomy as TX


def run(spark, cases, expr):
    rows = [(i, c) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r["i"]: r["v"] for r in df.select("i", expr(F.col("s")).alias("v")).collect()}
    return [got[i] for i in range(len(cases))]


def test_totals(spark):
    cases = {"5 LMB - 1-3.5 lbs": 5, "17": 17, '8/12-20"': 8, "30 under 2#": 30, "All tiny": None, "Fair number": None,
             "12 (best was 4.1)": 12, "2lb x3": 3, "three cats, 4 crappie": 4, "": None, "  ": None, None: None, "900 minnows": None,
             "1.2.5 lbs": None}
    assert run(spark, list(cases), X.count_total) == list(cases.values())


def test_total_of_many_numbers_looks_for_sizes_once(spark):
    """Before, each number searched the whole text for sizes again, so the time grew with the square of the numbers."""
    import time
    text = "9.5 lbs, " * 6000 + "7 bass"
    t = time.time()
    row = spark.createDataFrame([(text,)], "raw string").select(X.count_total(F.col("raw")).alias("n")).first()
    assert row.n == 7 and time.time() - t < 25


def test_total_falls_back_to_species_sum(spark):
    got = run(spark, ['9" bluegill and 3" 2.5 lb', "0.5 lb each"], X.count_total)
    assert got == [None, None]
    pairs = run(spark, ["3 LMB, 2 huge crappie, 4 black bass", "700 gar", "2 cats 1 cat"], X.species_pairs)
    assert [[(p["species"], p["n"]) for p in x] for x in pairs] == [
        [("largemouth", 7), ("crappie", 2)], [], [("catfish", 3)]]


def test_weights(spark):
    cases = {"Best five 24 lbs": None, "20lb bag. Largest 6lbs": 6.0, ".25lbs": 0.25, "3,5 lb": 3.5, "totaling 9 lbs, biggest 4 lbs": 4.0,
             "19 lbs": None, "up to 7#": 7.0, "2 lbs and 5 pounds": 5.0, "no numbers": None, "12 lbs stringer": None}
    assert run(spark, list(cases), X.max_weight) == list(cases.values())


def test_lengths(spark):
    cases = {'17" and 21 inches': 21.0, '3"': None, "55 in": None, "nothing": None}
    assert run(spark, list(cases), X.max_length) == list(cases.values())


def test_match_spans(spark):
    spans = run(spark, ["ab12c3", "x", "7"], lambda c: X.match_spans(c, r"\d+"))
    assert [[(s["start"], s["end"], s["text"]) for s in x] for x in spans] == [
        [(2, 4, "12"), (5, 6, "3")], [], [(0, 1, "7")]]


def test_clarity(spark):
    cases = {"visibility about 3 feet": 3.0, "very muddy, <2' visbility, about 6' less": 2.0, 'stained with visibility to 18"': 1.5,
             "clear with 5FT viz.": 5.0, "clear to 4'.": 4.0, "no numbers here": None, "visibility 45 feet": None, None: None}
    assert run(spark, list(cases), X.clarity_ft) == list(cases.values())
    labels = {"it cleared the water": None, "the ramp is large and clear": None, "Water was very clear today": "clear",
              "Lake slightly stained": "lightly_stained", "crystal clear pond, muddy creek": "gin_clear", "the water was muddy": "muddy"}
    assert run(spark, list(labels), X.clarity_label) == list(labels.values())


def test_water_temperature(spark):
    cases = {"Water temp was 56 to 58 degrees": 56.0, "Temperature in the high 30s": None, "water temp was 350 degrees": None,
             "water was 71 degrees": 71.0, "68 degree water": 68.0}
    assert run(spark, list(cases), X.water_temp) == list(cases.values())


def test_depth(spark):
    got = run(spark, ["in 3 to 8 feet of water, then out to 15'", "at 90 ft", "nothing", "around 6 ft"], X.depth_range)
    assert [(g["lo"], g["hi"]) for g in got] == [(3.0, 15.0), (None, None), (None, None), (6.0, 6.0)]


def test_windows_and_blanks(spark):
    assert run(spark, ["at dawn then afternoon", "8 am - noon", "8 am sharp", "after dark", "none"], X.bite_window) == [
        "dawn", "midday", "morning", "night", None]
    assert run(spark, ["We got skunked", "great day", None], lambda c: X.blank_flag(c, F.lit(None).cast("int"))) == [1, None, None]
    assert run(spark, ["We got skunked"], lambda c: X.blank_flag(c, F.lit(3))) == [0]


def test_vocabulary_tags(spark):
    body = "Thick hydrilla near the docks. " + "x" * 80 + " a little moss. Threw a drop shot."
    tags = run(spark, [body, None], lambda c: X.vocab_tags(c, X.FISHING_VOCABULARY))
    got = {(t["kind"], t["value"], t["detail"]) for t in tags[0]}
    assert got == {("vegetation", "hydrilla", "heavy"), ("vegetation", "moss", "light"), ("structure", "docks", None),
                   ("technique", "drop_shot", None)}
    assert tags[1] == []


TAX = TX.Taxonomy.from_entries({
    "colors": ["green pumpkin", "black and blue", "yellow", "shad"],
    "techniques": [{"match": ["drop shot", "dropshot"], "name": "drop_shot", "implies": "soft"}, {"match": ["weightless"], "name": "weightless", "implies": None}],
    "terms": [{"match": ["swim jig"], "category": "jig", "subtype": "swim"}, {"match": ["jig"], "category": "jig", "subtype": "unspecified"},
              {"match": ["rage craw", "craw"], "category": "soft", "subtype": "craw"}, {"match": ["yellow magic", "popper"], "category": "topwater", "subtype": "popper"},
              {"match": ["topwater"], "category": "topwater", "subtype": "unspecified"}, {"match": ["x (v.2)"], "category": "odd", "subtype": "odd"}],
    "ambiguous": ["various", "some"]})


def parse(spark, raw):
    df = spark.createDataFrame([(1, raw)], "obs_id int, label_raw string")
    return TX.label_parse_field(df, TAX)


@pytest.mark.parametrize("raw,kind,hits,techs", [
    ("Swim  Jigs", "hit", [("jig", "swim", None)], []),
    ("black and blue jig", "hit", [("jig", "unspecified", "black and blue")], []),
    ("Yellow Magic", "hit", [("topwater", "popper", None)], []),
    ("green pumpkin rage craw", "hit", [("soft", "craw", "green pumpkin")], []),
    ("Drop-Shot", "hit", [("soft", "unspecified", None)], ["drop_shot"]),
    ("weightless craw", "hit", [("soft", "craw", None)], ["weightless"]),
    ("various", "ambiguous", [], []), ("50", "ambiguous", [], []), ("shad some", "ambiguous", [], []),
    ("green pumpkin", "hit", [(None, None, "green pumpkin")], []), ("Zorblax 9000", "unknown", [], []),
    ("craw jig", "hit", [("soft", "craw", None), ("jig", "unspecified", None)], [])])
def test_label_parts(spark, raw, kind, hits, techs):
    row = parse(spark, raw).first()
    assert (row["kind"], [tuple(h) for h in row["hits"]], row["techniques"]) == (kind, hits, techs)


def test_label_split_and_dedupe(spark):
    parsed = parse(spark, "topwater poppers; jig / craw then Zorblax")
    assert [r["part"] for r in parsed.orderBy("pos").collect()] == ["topwater poppers", "jig", "craw", "Zorblax"]
    hits = TX.label_dedupe(TX.field_hits(parsed))
    assert {(r["category"], r["subtype"]) for r in hits.collect()} == {("topwater", "popper"), ("jig", "unspecified"), ("soft", "craw")}
    assert [(r["raw"], r["n"]) for r in TX.review_queue(parsed).collect()] == [("Zorblax", 1)]


def test_scan_text(spark):
    df = spark.createDataFrame([(1, "Threw a swim-jig, then the rage craws."), (2, None)], "obs_id int, body string")
    got = {(r["category"], r["subtype"], r["raw"]) for r in TX.label_scan_text(df, TAX).collect()}
    assert got == {("jig", "swim", "swim-jig"), ("jig", "unspecified", "jig"), ("soft", "craw", "rage craws")}


def test_taken_words_bring_others_together(spark):
    row = parse(spark, "swim weightless jig").first()          # found only once the technique is out
    assert (row["kind"], [tuple(h) for h in row["hits"]], row["techniques"]) == ("hit", [("jig", "swim", None)], ["weightless"])
    row = parse(spark, "rage topwater craw").first()
    assert [tuple(h)[:2] for h in row["hits"]] == [("topwater", "unspecified"), ("soft", "craw")]


def plain_parse(part, tax):
    """The rules in plain Python, form by form."""
    import re
    text = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s\"'.-]", " ", part.lower().replace("&", " and "))).strip()
    if text in tax.ambiguous or text.isdigit():
        return ("ambiguous", [], [])
    techs, implied, hits, color = [], None, [], None
    for form, name, implies in tax.techniques:
        if re.search(TX.phrase_pattern(form), text):
            techs += [name] * (name not in techs)
            text = re.sub(TX.phrase_pattern(form), " ", text).strip()
            implied = implied or implies
    left = text
    for form, cat, sub in tax.terms:
        if m := re.search(TX.phrase_pattern(form), left):
            hits.append((cat, sub))
            left = (left[:m.start()] + " " + left[m.end():]).strip()
    for name in tax.colors:
        if re.search(TX.phrase_pattern(name), left):
            color, left = name, re.sub(TX.phrase_pattern(name), " ", left)
            break
    left = " ".join(left.split())
    if hits:
        return ("hit", [(c, s, color) for c, s in hits], techs)
    if implied:
        return ("hit", [(implied, "unspecified", color)], techs)
    if not left:
        return ("hit", [(None, None, color)], techs) if color else ("empty", [], techs)
    return ("ambiguous" if left in tax.ambiguous else "unknown", [], techs)


def test_dictionary_is_the_patterns_one_by_one(spark):
    import random
    rng, words = random.Random(6), ["ab", "a", "b", "bs", "cc", "ccs", "d", "a-b", "x9", "q"]
    form = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    tax = TX.Taxonomy.from_entries({
        "colors": [form() for _ in range(5)], "ambiguous": [form() for _ in range(4)],
        "techniques": [{"match": [form()], "name": f"t{k}", "implies": rng.choice([None, "i"])} for k in range(6)],
        "terms": [{"match": [form(), form()], "category": f"c{k % 4}", "subtype": f"s{k}"} for k in range(14)]})
    join = lambda: rng.choice([" ", "-", "", " - ", "'", "  ", "."])
    texts = sorted({"".join(rng.choice(words) + join() for _ in range(rng.randint(1, 7))).strip(" .-\"'") for _ in range(400)} - {""})
    got = {r["part"]: (r["kind"], [tuple(h) for h in r["hits"]], r["techniques"]) for r in TX.parse_parts(
        spark.createDataFrame([(t,) for t in texts], "part string"), tax).collect()}
    assert {t: got[t] for t in texts} == {t: plain_parse(t, tax) for t in texts}
    scanned = {}
    for r in TX.label_scan_text(spark.createDataFrame(list(enumerate(texts)), "obs_id int, body string"), tax).collect():
        scanned.setdefault(r["obs_id"], {})[r["category"], r["subtype"]] = r["raw"]
    import re
    for k, t in enumerate(texts):
        norm = re.sub(r"\s+", " ", t).strip()
        want = {}
        for f, c, s in tax.terms:
            if (m := re.search(TX.phrase_pattern(f), norm)) and (c, s) not in want:
                want[c, s] = m.group(0)
        assert scanned.get(k, {}) == want


def test_forms_are_looked_up_only_at_words_that_can_open_one(spark):
    from fieldledger.operators import dictionary as D
    index = D.form_index(spark.createDataFrame([("the of",), ("o'neil rod",)], "form string"))
    assert {r.word for r in D.openings(index).collect()} == {
        "the", "theof", "theofs", "o", "oneil", "oneilrod", "oneilrods"}
    texts = spark.createDataFrame([(1, "a the-ofs b theof c o'neil  rods the"), (2, "nothing here"), (3, ""), (4, None)], "obs_id int, _text string")
    found = D.find_forms(texts, index, 3).select("obs_id", "form", "at", "raw").collect()
    assert {tuple(r) for r in found} == {(1, "the of", 2, "the-ofs"), (1, "the of", 5, "theof"), (1, "o'neil rod", 7, "o'neil  rods")}


def test_words_that_open_no_form_are_no_rows_of_a_join(spark):
    from fieldledger.operators import dictionary as D
    index = D.form_index(spark.createDataFrame([("the of",)], "form string"))
    texts = spark.createDataFrame([(1, "the of " + "plain words " * 50)], "obs_id int, _text string")
    plan = D.find_forms(texts, index, 2)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Generate explode") == 1


def test_filter_of_bits(spark, monkeypatch):
    from fieldledger.operators import dictionary as D
    inside = spark.range(1000).select(F.format_string("in%d", "id").alias("word"))
    outside = spark.range(1000).select(F.format_string("out%d", "id").alias("word"))

    def passed(rows, of):
        return rows.crossJoin(D.bits_of(of, "word")).where(D.has_bit(F.col("bits"), F.col("word"))).count()

    assert passed(inside, inside) == 1000 and passed(outside, inside) < 125 and passed(inside, inside.limit(0)) == 0
    monkeypatch.setattr(D, "LARGEST", 10)
    assert passed(inside, inside) == 1000 and passed(outside, inside) < 1000


def test_normalize_text_against_plain_patterns(spark):
    import random
    import re
    from fieldledger.functions.text import normalize_text
    rng = random.Random(2)
    texts = ["".join(rng.choice("aZ09 \t\n\x0b\r\x00\x7f\x85\xa0é\U0001f600&-.'\",;_") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"""[^a-z0-9\s"'.-]""", " ", t.lower().replace("&", " and "), flags=re.A), flags=re.A).strip(" ")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_text(F.col("t")).alias("n")).collect()
    assert len(got) == 2000 and all(r.n == plain(r.t) for r in got)


def test_hundred_thousand_forms(spark):
    from fieldledger.operators.dictionary import scan_forms
    k = F.col("id")
    forms = spark.range(100_000).select(k.cast("int").alias("rank"), F.format_string("thing%d of kind%d", k, k % 7).alias("form"),
                                        (k % 100).cast("string").alias("category"), k.cast("string").alias("subtype"))
    texts = spark.range(500).select(k.alias("obs_id"), F.format_string(
        "A thing%d-of kind%d, then THING%d of kind%d's and more.", k, k % 7, k + 1, k % 7).alias("body"))
    got = {(r["obs_id"], r["subtype"], r["raw"]) for r in scan_forms(texts, forms).collect()}
    assert got == {(i, str(i), f"thing{i}-of kind{i % 7}") for i in range(500)} | {
        (i, str(i + 1), f"thing{i + 1} of kind{i % 7}") for i in range(500) if (i + 1) % 7 == i % 7}
    assert scan_forms(texts.limit(0), forms).count() == 0 and scan_forms(texts, forms.limit(0)).count() == 0


def test_merge_prefers_the_field(spark):
    rows = [(1, "a", "s", "raw1", "red", "narrative", 0), (1, "a", "s", "raw2", None, "field", 3), (1, "b", "t", "raw3", None, "narrative", 1)]
    df = spark.createDataFrame(rows, "obs_id int, category string, subtype string, raw string, color string, source string, seq int")
    got = {(r["category"], r["raw"], r["source"]) for r in TX.label_merge_sources(df).collect()}
    assert got == {("a", "raw2", "field"), ("b", "raw3", "narrative")}


def test_catch_rows(spark):
    rows = [(1, "4 bass 2 crappie", None), (2, "6", "nice crappie"), (3, "6", "x"), (4, "Fair number", "bass")]
    df = rules.totals(spark.createDataFrame(rows, "obs_id int, raw string, body string"))
    got = {(r["obs_id"], r["species"], r["n"]) for r in rules.catch_rows(df).collect()}
    assert got == {(1, "largemouth", 4), (1, "crappie", 2), (2, "crappie", 6), (3, "unspecified", 6)}


def test_names_and_stems(spark):
    assert run(spark, [" A  :  B ., ", "Tara lake", " .,", None], N.normalize_unit_name) == ["A: B", "Tara lake", None, None]
    assert run(spark, ["Cody & Sons: East Lake!"], N.slugify) == ["cody_and_sons_east_lake"]
    assert run(spark, ["batteries", "boxes", "grass", "docks", "bus", "island points"], X.stem_phrase) == [
        "battery", "box", "grass", "dock", "bus", "island point"]


def test_greedy_dedupe_equals_brute_force(spark):
    import random
    rng = random.Random(5)
    words = ["island", "point", "battery", "batteries", "eagle", "eagles", "spill", "way", "spillway", "dock", "docks"]
    rows = []
    for u in ("a", "b"):
        seen = set()
        for _ in range(40):
            p = " ".join(rng.sample(words, rng.choice([1, 2])))
            if p not in seen:
                seen.add(p)
                rows.append((u, p, rng.random() * 9))
    got = {}
    for r in P.phrase_greedy_dedupe(spark.createDataFrame(rows, "unit string, phrase string, score double"), keep=6).orderBy("unit", "rank").collect():
        got.setdefault(r["unit"], []).append(r["phrase"])

    def stem(p):
        out = []
        for w in p.split():
            out.append(w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w)
        return " ".join(out)

    for u in ("a", "b"):
        kept = []
        for _, p, _s in sorted((r for r in rows if r[0] == u), key=lambda r: -r[2]):
            if len(kept) < 6 and not any(p in k or k in p or stem(p) == stem(k) for k in kept):
                kept.append(p)
        assert got[u] == kept


def test_snippets(spark):
    rows = [("u", 2, "We drove down from Tyler on a cold day. Fished 3 hours north of Bonham all day."), ("u", 1, "We drove down from Tyler on a cold day. Short one. The lake sits in Fannin County somewhere."),
            ("u", 3, "four wheel drive needed on highway 12 after rain.")]
    df = spark.createDataFrame(rows, "unit string, obs_id int, body string")
    got = [r["sentence"] for r in rules.snippets(df).orderBy("rank").collect()]
    assert got == ["We drove down from Tyler on a cold day.", "The lake sits in Fannin County somewhere."]


def test_dates_and_commas(spark):
    assert [str(x) if x else None for x in run(spark, ["Sep 11 2026", "Mar 09 2014", "junk", "", "Feb 30 2011"], H.parse_posted_date)] == [
        "2026-09-11", "2014-03-09", None, None, None]
    slots = run(spark, ["09/11/2026 AM -", "04/03/2026 All Day -", "13/45/2026 AM", ""], lambda c: H.parse_reservation(c)[1])
    assert slots == ["AM", "ALL_DAY", None, None]
    names = run(spark, ["Dog: East Lake, Henderson", "Butler Lake , Brenham", "NoComma", ""], lambda c: F.struct(*[x.alias(n) for n, x in zip("ab", H.split_on_last_comma(c))]))
    assert [tuple(n) for n in names] == [("Dog: East Lake", "Henderson"), ("Butler Lake", "Brenham"), ("NoComma", None), (None, None)]


def test_entities_are_decoded_once(spark):
    assert run(spark, ["a&nbsp;b &amp;lt; &#039;q&#x27; &rsquo;", "plain"], H.unescape) == ["a b &lt; 'q' ’", "plain"]


def test_every_pattern_compiles_in_the_engine(spark):
    patterns = [p for _, p in V.BITE_WINDOW + V.CLARITY_LABELS + V.DENSITY] + V.WATER_TEMP + V.CLARITY_NUMBERS + [V.DEPTH, V.COUNT_SPECIES, V.BAG, V.SINGLE]
    df = spark.createDataFrame([("x",)], "s string")
    assert df.select(*[F.col("s").rlike(p).alias(f"c{i}") for i, p in enumerate(patterns)]).count() == 1


def _plain_phrases(rows, stop, names):
    """Documents' words without stop words and names, and their distinct words and neighbours."""
    import re
    out = {}
    for obs, unit, body in rows:
        if unit is None or body is None:
            continue
        words = [w for w in re.sub("[^a-z0-9']+", " ", body.lower()).strip().split(" ")
                 if len(w) > 2 and not re.search(r"\d", w) and w not in stop and w not in names]
        out[obs] = (unit, words, set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])})
    return out


@pytest.mark.parametrize("buckets", [3, 1 << 16])
def test_phrases_equal_plain_counts(spark, monkeypatch, buckets):
    """Hash buckets choose which phrases are counted by name; few buckets, all full, give the same rows."""
    import math
    import random
    monkeypatch.setattr(P, "BUCKETS", buckets)
    rng = random.Random(11)
    vocabulary = ["reef", "wall", "cove", "the", "pike", "Red", "dock2", "it's", "mud", "bar", "rock", "ox"]
    rows = [(i, "hot" if i % 3 else f"u{i % 4}", " ".join(rng.choices(vocabulary, range(1, 13), k=rng.choice([0, 1, 2, 40])))) for i in range(90)]
    rows += [(90, None, "reef wall"), (91, "hot", None), (92, "hot", ""), (93, "hot", "reef " * 3000), (94, "lone", "pike")]
    names = {"cove", "red"}
    docs = spark.createDataFrame(rows, "obs_id long, unit string, body string")
    words = P.kept_words(docs, ["the"], spark.createDataFrame([(n,) for n in sorted(names)], "token string"))
    plain = _plain_phrases(rows, {"the"}, names)
    assert {r.obs_id: (r.unit, r.words) for r in words.collect()} == {k: v[:2] for k, v in plain.items()}
    sets = P.phrase_sets(words)
    assert {r.obs_id: set(r.phrases) for r in sets.collect()} == {k: v[2] for k, v in plain.items()}
    assert all(len(r.phrases) == len(set(r.phrases)) for r in sets.collect())
    df, club, n = {}, {}, {}
    for unit, _, phrases in plain.values():
        n[unit] = n.get(unit, 0) + 1
        for p in phrases:
            df[unit, p] = df.get((unit, p), 0) + 1
            club[p] = club.get(p, 0) + 1
    assert {(r.unit, r.phrase): r.df for r in P.mention_index(sets).collect()} == df
    passed = {k: v for k, v in df.items() if v >= 3 and v / n[k[0]] >= 0.1}
    assert {(r.unit, r.phrase): r.df for r in P.frequent_phrases(sets, 3, 0.1).collect()} == passed
    lift = {k: math.log(((v + .5) / (n[k[0]] + 1)) / ((club[k[1]] + .5) / (len(plain) + 1))) for k, v in passed.items()}
    got = {(r.unit, r.phrase): r.score for r in P.distinctive_phrases(sets, 3, 0.1, 0.05).collect()}
    want = {k: v * math.log1p(passed[k]) for k, v in lift.items() if v > 0.05}
    assert want and got == pytest.approx(want)
    tokens = {}
    for _, words_, _p in plain.values():
        for w in words_:
            tokens[w] = tokens.get(w, 0) + 1
    assert {r.token: r.n for r in P.phrase_tokens(words).collect()} == tokens


def test_phrases_of_no_documents(spark):
    docs = spark.createDataFrame([], "obs_id long, unit string, body string")
    words = P.kept_words(docs, ["the"], spark.createDataFrame([], "token string"))
    assert P.phrase_tokens(words).count() == 0 and P.distinctive_phrases(P.phrase_sets(words)).count() == 0


def test_phrases_are_built_without_a_shuffle_of_words(spark):
    """Between words and phrases there is no exchange; only names that occur are moved, by document."""
    words = spark.createDataFrame([(1, "a", ["x", "y"])], "obs_id long, unit string, words array<string>")
    plan = P.phrase_sets(words)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_words_are_read_once_and_stay_in_their_row(spark):
    """Words are whole runs of the alphabet, found once; few names and few full buckets go to the rows, which are not dealt by key."""
    texts = ["The theme, the 'the' a1b abc12 12abc it's x_yz-THE", "", None, "ÉKey reef's ab abc", "the"]
    docs = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "obs_id long, unit string, body string")
    words = P.kept_words(docs, ["the", "x.z"], spark.createDataFrame([("yz",), ("abc",)], "token string"))
    assert {r.obs_id: r.words for r in words.collect()} == {0: ["theme", "'the'", "it's"], 1: [], 3: ["key", "reef's"], 4: []}
    assert {r.obs_id: r.w for r in docs.select("obs_id", P.word_array(F.col("body"), []).alias("w")).collect()}[4] == ["the"]
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "SortMergeJoin" not in plan
    plan = P.frequent_phrases(P.phrase_sets(words), 1, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and all("Broadcast" in row for row in plan.splitlines() if "LeftSemi" in row)


def test_snippets_cut_long_texts_in_one_pass(spark):
    """A text of a million characters without an end of a sentence, and ends that follow one another."""
    import time
    rows = [(1, "u", "x | " * 250_000), (2, "u", "First we drove to Tyler and beyond!! Then north of Waco it rained?  And no end"), (3, "u", None), (4, "u", "")]
    df = spark.createDataFrame(rows, "obs_id long, unit string, body string")
    begun = time.time()
    got = [(r.rank, r.sentence) for r in rules.snippets(df, min_chars=10).collect()]
    assert got == [(1, "First we drove to Tyler and beyond!"), (2, "Then north of Waco it rained?")] and time.time() - begun < 30
