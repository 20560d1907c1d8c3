from pyspark.sql import functions as F

from fieldledger.functions import html as H
from fieldledger.operators import ingest as I, pages as P

REPORT = """<html><head><title>skip</title></head><body><h2 class="text-dark mb-5"> Slow &amp; steady </h2>
<div class="post_left"><div class="user"><p>Sep 11 2026</p><h3>  ANN
 EXAMPLE </h3><p>Fry</p></div><div class="user-meta d-flex"><div><p>Since <em>2025</em> Posts <em> 12</em> <em>x</em></p></div></div></div>
<div class="post-right w-100"><div class="row"><div class="col">%s<p>First part.&nbsp; Ok.</p>
<p>Second <b>part</b>.<div class="postedBy">Posted By: Ann</div></div></div>
<div class="row"><div class="col report-gallery"><a href="1"><img></a><a href="2"></a></div></div></div><p>Upload here</p></body></html>"""
FIELDS = """<p><strong>Reservation Number : </strong> 48003<br /><strong>Property Name : </strong> JJ Lake<br/><strong>Other : </strong> no<br>
<strong>Reservation Date : </strong> 09/11/2026 AM - <br /><strong>Total Fish/Sizes : </strong> 4 LMB - 2-2.5 lbs<br /><strong>Lures Used : </strong> Fluke; Worm<br /></p>"""


def pages(spark, *docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "page_id int, html string")


def test_report_pages(spark):
    modern, legacy = P.parse_report_page(pages(spark, REPORT % FIELDS, REPORT % "")).orderBy("page_id").collect()
    assert (modern["title"], str(modern["posted_date"]), modern["author"], modern["author_rank"]) == ("Slow & steady", "2026-09-11", "ANN EXAMPLE", "Fry")
    assert (modern["member_since"], modern["post_count"], modern["photo_count"], modern["era"]) == (2025, 12, 2, "structured")
    assert (modern["property_name"], str(modern["trip_date"]), modern["slot"], modern["raw"], modern["label_raw"]) == (
        "JJ Lake", "2026-09-11", "AM", "4 LMB - 2-2.5 lbs", "Fluke; Worm")
    assert modern["body"] == "First part. Ok.\n\nSecond part." == legacy["body"]
    assert (legacy["era"], legacy["property_name"], legacy["trip_date"], legacy["label_raw"]) == ("legacy", None, None, None)


def test_missing_stub(spark):
    stub = "<html>A PHP Error was encountered</html>"
    df = pages(spark, stub, stub + "x" * 12001, "fine", '<div class="post-right">A PHP Error was encountered, they wrote</div>')
    assert [r["page_id"] for r in P.missing_stub_filter(df).orderBy("page_id").collect()] == [2, 3]


def test_long_fields_stay_whole(spark):
    name = "Lake " + "of the many winding arms " * 9 + "end"
    card = f'<div class="divTableRow"><div class="table-summary"><a href="/view_report/7">T</a> <i>Property</i> : {name}, Town<br> Started By : Jo, Apr 19, 2015</div></div>'
    r = P.parse_listing_cards(pages(spark, card, card.replace("<i>Property</i>", "Property"))).orderBy("page_id").collect()
    assert [(x["lake_name"], x["lake_town"]) for x in r] == [(name, "Town")] * 2
    boat, rule = "Two jon boats " * 12 + "and a canoe", "Please harvest " + "any fish under fourteen inches and " * 12 + "no others."
    html = f"<h1>V</h1>Property Info 3 acres Boat Availability {boat} Boat Launch none. {rule} x"
    u = P.parse_unit_page(spark.createDataFrame([("n", html)], "slug string, html string")).first()
    assert (u["boat_type"], u["harvest_rules"]) == (boat, rule)


def test_entities_of_any_length(spark):
    text = "&#0000000065; &#x0000000042; &#99999999; &#xFFFFFFFFFF; &#55296;"
    got = spark.createDataFrame([(text,)], "t string").select(H.unescape(F.col("t")).alias("t")).first()["t"]
    assert got == "A B \ufffd \ufffd \ufffd"


def read(page, boxes=(), leaves=()):
    from fieldledger.functions.markup import Reader
    return Reader(list(boxes), list(leaves)).read(page)[0]


def test_unclosed_elements():
    inner = lambda page: [n[7] for n in read(page, leaves=[".a"])]
    assert inner('<div class="a"><div>x</div>y') == ["<div>x</div>y"]
    assert inner('<div class="b">') == [] and inner("<div class='z a'>1</div>2") == ["1"] and inner("<DIV CLASS=a>1</div>2") == ["1"]
    texts = lambda page: [(n[0], n[6]) for n in read(page, leaves=["p", "b", "li"])]
    assert texts("<p>one<p>two <b>bold<div>three</div></p>") == [("p", "one"), ("p", "two bold"), ("b", "bold")]
    assert texts("</b></p><p><br>x</i> &amp; <img alt='a>b'>y&nbsp; z</p></p>") == [("p", "x & y z")]
    assert texts("<!-- <p>no --><script>var a = '<p>';</script><p>yes<!-- x") == [("p", "yes")]
    assert texts("<article><p>in</article>out") == [("p", "in")] and texts("") == [] and texts("a < b <3 <p") == []
    assert texts('<p>a</p><p>b<a href="x>c</p>') == [("p", "a"), ("p", "b")]           # the quote never ends


def test_numbers_tell_what_is_inside():
    nodes = read('<ul class="u"><li><p>1<p>2</li></ul><p>3', boxes=[".u"], leaves=["p"])
    assert [(n[0], n[2], n[3], n[4]) for n in nodes] == [("ul", 0, 0, 2), ("p", 2, 1, 1), ("p", 2, 2, 2), ("p", 0, 3, 3)]


def test_tags_are_remembered_within_bounds():
    from fieldledger.functions import markup
    reader = markup.Reader([".a"], ["p"])
    long = f'<p title="{"x" * 5000}">'
    page = '<div class="a"><p>one</p></div>' * 3 + "<!-- <p> -->" + long + "two"
    once, again = reader.read(page), reader.read(page)
    assert once == again and [n[6] for n in once[0]] == [None, "one"] * 3 + ["two"]
    assert set(reader.known) == {'<div class="a">', "<p>", "</p>", "</div>", "<!-- <p> -->"}
    for k in range(markup.KNOWN + 5):
        reader.read(f"<i id={k}>")
    assert len(reader.known) <= markup.KNOWN


def test_large_and_hostile_pages(spark):
    import time
    million = "<p>" + "word &amp; <b>more</b> " * 45_000
    deep, quotes = "<div class=a>" * 60_000 + "x", '<a href="' * 50_000
    cards = '<div class="divTableRow"><div class="table-summary"><a href="/view_report/%d">T</a></div></div>'
    listing = "".join(cards % k for k in range(12_000))
    began = time.time()
    assert len(read(million, leaves=["p"])[0][6]) == 45_000 * 12 - 1
    nodes = read(deep, boxes=[".a"])
    assert len(nodes) == 60_000 and max(n[2] for n in nodes) == 512
    read(quotes, leaves=["a"])
    read("</i>" * 100_000 + "<b>" * 100_000 + "</u>" * 100_000, leaves=["p"])
    assert P.parse_listing_cards(pages(spark, listing)).count() == 12_000
    assert time.time() - began < 60


def test_null_and_empty_pages(spark):
    from fieldledger.operators import markup as M
    df = pages(spark, None, "", "<p>a</p>")
    got = M.elements(df, [], ["p"], whole="text").orderBy("page_id").collect()
    assert [(len(r["nodes"]), r["text"]) for r in got] == [(0, ""), (0, ""), (1, "a")]
    assert M.records(df, "p", []).count() == 1 and M.elements(df.limit(0), [], ["p"]).count() == 0


def test_last_card_wins_and_towns_split(spark):
    card = ('<div class="divTableRow"><div class="table-summary"><a href="/forums/view_report/7">T%d</a> Property : A: B, Town<br> Started By : Jo, Apr 19, 2015</div>'
            '<div class="table-replies"><span>Replies :</span> %d</div><div class="table-views">9 seen 41</div></div>')
    row = P.parse_listing_cards(pages(spark, card % (1, 1) + card % (2, 5))).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["title"], r["lake_name"], r["lake_town"], r["author"], str(r["posted_date"]), r["replies"], r["views"]) == (
        "T2", "A: B", "Town", "Jo", "2015-04-19", 5, 41)


def test_unit_page_ignores_embedded_reports(spark):
    html = ("<h1>Van, North Lake</h1><p>Property Info 13 acres, depths reaching 15 feet, pockets (up to 12 feet). Day Rate: $95 Half-Day Rate: $1,070.50 Bank fishing is available. "
            "Gold and Silver Members Boat Availability Two boats Boat Launch</p>Reservation Number 5 deep diving crank 60 feet deep 400 acres")
    df = spark.createDataFrame([("n", html), ("x", "<p>no marker</p>")], "slug string, html string")
    r = P.parse_unit_page(df).collect()
    assert len(r) == 1
    assert (r[0]["acres"], r[0]["max_depth_ft"], r[0]["day_rate"], r[0]["half_day_rate"], r[0]["bank_fishing"], r[0]["boat_type"]) == (13.0, 15.0, 95.0, 1070.5, 1, "Two boats")


def test_markers(spark):
    ok = '{"id":"9","title":" Twin  Lakes ","lat":"32.5","lon":"-96.1","content":"<h4>Ben Wheeler</h4><a href=\\"/view-property/Twin_Lakes\\">"}'
    out_of_range = '{"id":"1","title":"Far","lat":"50.0","lon":"-96.1","content":""}'
    again = ok.replace('"9"', '"10"')
    rows = P.json_marker_extract(pages(spark, f"x [{ok},{out_of_range},{again},{{bad}}]")).collect()
    assert [(r["club_id"], r["title"], r["slug"], r["place"]) for r in rows] == [("9", "Twin Lakes", "twin_lakes", "Ben Wheeler")]


def test_upserts(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "a", 2), (1, "b", 3), (2, None, 4), (2, None, 5)], "k int, attr string, seq int")
    got = {r["k"]: (r["attr"], r["seq"]) for r in I.upsert_prefer_populated(df, ["k"], "attr", "seq").collect()}
    assert got == {1: ("a", 2), 2: (None, 4)}
    got = {r["k"]: r["seq"] for r in I.upsert_latest(df, ["k"], ["seq"]).collect()}
    assert got == {1: 3, 2: 5}


def test_failure_guard_stops(spark):
    import pytest
    df = spark.createDataFrame([(True,), (False,), (False,)], "failed boolean")
    with pytest.raises(Exception, match="failure rate"):
        I.failure_rate_guard(df, F.col("failed")).collect()
    assert I.failure_rate_guard(df, F.col("failed"), limit=0.5).first()["attempted"] == 3


def test_overrides_from_file(spark, tmp_path):
    from fieldledger.sources.files import load_overrides
    f = tmp_path / "c.csv"
    f.write_text("lake,town,lat,lon,reports,uncertain,confirmed,note\nA,t,1.5,2.5,3,0,yes,\nB,t,1,2,3,0,,\nC,t,x,2,3,0,Y,\n")
    assert [tuple(r) for r in load_overrides(spark, str(f)).collect()] == [("A", 1.5, 2.5)]


def test_page_store_round_trip(spark, tmp_path):
    from fieldledger.sources.files import read_pages, write_pages
    df = spark.createDataFrame([("u1", "report", "1", 200, False, None, "<p>"), ("u2", "index", "2", 200, True, None, None)],
                               "url string, kind string, ref string, http_status int, is_missing boolean, fetched_at timestamp, html string")
    write_pages(df, str(tmp_path / "p"))
    kept = P.page_scan(read_pages(spark, str(tmp_path / "p")), "report")
    assert [r["url"] for r in kept.collect()] == ["u1"]
    assert "PartitionFilters: [isnotnull(kind" in kept._jdf.queryExecution().executedPlan().toString()
