"""Reference files, written and read back through Spark."""
import json

import pytest
from pyspark.sql import functions as F

from fieldledger.operators.ingest import payload_sink, publish, published
from fieldledger.sources import files as S


def save(path, doc) -> str:
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def test_aliases_slugs_and_candidates(spark, tmp_path):
    aliases = S.load_aliases(spark, save(tmp_path / "a.json", {"aliases": {"Old Name": "New", "Older": "New"}}))
    assert {tuple(r) for r in aliases.collect()} == {("Old Name", "New"), ("Older", "New")}
    slugs = S.load_slugs(spark, save(tmp_path / "s.json", {"big_pond": "Big Pond"}))
    assert [tuple(r) for r in slugs.select("slug", "name").collect()] == [("big_pond", "Big Pond")]
    place = {"county": "C", "state": "S", "lat": 1.5, "lon": 2.5, "population": 7}
    towns = S.load_candidates(spark, save(tmp_path / "c.json", {"T": [place, dict(place, county="D")], "none": []}))
    assert sorted(r["county"] for r in towns.collect()) == ["C", "D"]


def test_taxonomy_puts_longer_forms_first(spark, tmp_path):
    doc = {"terms": [{"match": ["bolt", "long bolt"], "category": "x", "subtype": "y"}], "colors": ["red", "dark red"],
           "techniques": [{"match": ["drag"], "name": "dragging"}], "ambiguous": ["Misc"]}
    tax = S.load_taxonomy(spark, save(tmp_path / "t.json", doc))
    assert [t[0] for t in tax.terms] == ["long bolt", "bolt"] and tax.colors == ["dark red", "red"]
    assert tax.techniques == [("drag", "dragging", None)] and tax.ambiguous == ["misc"]


def test_yaml_needs_a_reader(spark, tmp_path):
    path = save(tmp_path / "t.yaml", "terms: []\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="JSON"):
            S.load_taxonomy(spark, path)
    else:
        assert S.load_taxonomy(spark, path).terms == []


def test_payload_is_written_by_section(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    second = spark.createDataFrame([(3.5,)], "x double")
    payload_sink({"one": first, "two": second}, str(tmp_path / "out"))
    back = {(r["section"], r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert back == {("one", '{"k":1,"v":"a"}'), ("one", '{"k":2,"v":"b"}'), ("two", '{"x":3.5}')}


def test_documents_are_published_by_section_and_key(spark, tmp_path):
    """Nulls, quotes, line ends, halves, equal rows and an empty section; one section written again."""
    import json
    schema = "unit string, n long, x double, ok boolean, zed string"
    rows = [("a", 2, 0.1, True, 'say "x"\nand \\ é'), ("a", 1, None, None, None), ("a", 1, None, None, None), ("b", 3, -1e7, False, ""), (None, 4, 0.0, None, "z")]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "out")
    publish({"one": (df, ["unit"]), "all": (df, []), "none": (df.limit(0), ["unit"])}, path)
    publish({"all": (df.where("n = 3"), [])}, path)
    got = {(r.section, r.key): r.document for r in published(spark, path).select("section", "key", F.to_json("document").alias("document")).collect()}
    assert got["one", "a"] == ('[{"n":1,"ok":null,"unit":"a","x":null,"zed":null},{"n":1,"ok":null,"unit":"a","x":null,"zed":null},'
                               '{"n":2,"ok":true,"unit":"a","x":0.1,"zed":"say \\"x\\"\\nand \\\\ é"}]')
    assert json.loads(got["all", ""]) == [{"n": 3, "ok": False, "unit": "b", "x": -10000000, "zed": ""}]
    assert set(got) == {("one", "a"), ("one", "b"), ("one", ""), ("all", "")}
    values = published(spark, path).where("section = 'one' AND key = 'a'").select(F.variant_get("document", "$[2].x", "double").alias("x")).first()
    assert values["x"] == 0.1
