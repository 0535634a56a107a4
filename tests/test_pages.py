import json

import pytest
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed
from staygauge.functions.page_elements import Outline, Selectors, page_elements, read_page
from staygauge.operators import extraction as ex
from staygauge.operators.extraction import jsonld_fields, lodging_blocks, price_for_nights


def text_values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_price_tiers(spark):
    gap = " - " * 30
    texts = [
        "₪1,670 for 4 nights", "from $0 for 2 nights, €1,962 Show price breakdown for 4 nights", "Parking fee: $40 per night",
        f"Parking fee: $40 per night {gap} CA$ 90 per night {gap} CA$120 a night", f"{gap}CHF 75{gap}Cleaning fee $5", "nothing here", None,
        "US$1,000 for 2 nights", f"A$99{gap}$20 deposit"]
    got = text_values(spark, texts, ex.price_in_text)
    assert [tuple(g) if g else None for g in got] == [
        ("₪", 1670.0, 4.0), ("€", 1962.0, 4.0), None, ("CA$", 90.0, None), ("CHF", 75.0, None), None, None, ("US$", 1000.0, 2.0), ("A$", 99.0, None)]


def test_fee_context_is_exactly_fifty_characters(spark):
    texts = [f"cleaning{'x' * (50 - 8 - over)}$9" for over in (0, -1)] + [f"$9{'x' * (50 - 5 + over)}valet" for over in (0, 1)]
    got = text_values(spark, texts, ex.price_in_text)
    assert [g is None for g in got] == [True, False, True, False]


def test_sections_and_facts(spark):
    text = "About this place Nice  flat Where you'll be Near the sea Reviews 4.97 · 92 reviews Hosting since 2015 Response rate: 98%"
    assert text_values(spark, [text, "no"], lambda t: ex.section_text(t, "About this place")) == ["Nice flat", None]
    assert text_values(spark, [text], lambda t: ex.section_text(t, "Where you'll be")) == ["Near the sea"]
    assert text_values(spark, [text], lambda t: ex.number_in_text(t, ex.fixed.RATING_AND_REVIEWS)) == [4.97]
    assert text_values(spark, [text], lambda t: ex.first_group(t, ex.fixed.RESPONSE_RATE)) == ["98%"]


@pytest.mark.parametrize("price, nights, check_in, check_out, per_night, total", [
    (4156.0, 4.0, "2027-01-01", "2027-01-05", 1039.0, 4.0), (1962.0, None, "2027-01-01", "2027-01-05", 490.5, 4.0), (100.0, None, None, None, 100.0, None),
    (100.0, None, "2027-01-05", "2027-01-01", 100.0, None), (100.0, 0.0, "2027-13-01", "2027-01-05", 100.0, 0.0), (0.0, 2.0, None, None, None, 2.0),
    (None, None, "2027-01-01", "2027-01-05", None, None)])
def test_nightly_price(spark, price, nights, check_in, check_out, per_night, total):
    df = spark.createDataFrame([(price, nights, check_in, check_out)], "p double, n double, i string, o string")
    got = df.select(*ex.nightly_price(F.col("p"), F.col("n"), F.col("i"), F.col("o"))).first()
    assert tuple(got) == (per_night, total)


PAGE = """<!doctype html><html><head><title>x</title><script type="application/ld+json">{bad</script>
<script type="application/ld+json">%s</script><style>p {}</style></head><body>
<section><div><h2 elementtiming="LCP-target">Private room in flat in Greater London, United Kingdom 4.9</h2></div>
<ol class="a lgx66tx"><li>2026 guests</li><li>4 guests<span> · </span></li><li>2 bedrooms</li><li>3 beds</li><li>1.5 baths</li></ol></section>
<div data-testid="title">Nice &amp; <b>new</b></div><div>5 guests · Studio</div>
<div data-testid="price">&euro;80</div><p>4.5 · 12 reviews</p><p>33 reviews · Superhost</p></body></html>"""


def parsed(spark, html, url="https://x.example/rooms/42?check_in=2026-04-13&check_out=2026-04-15"):
    df = spark.createDataFrame([(html, url, None, "2026-01-01T00:00:00Z", "7")], "html string, url string, listing_id string, capturedAt string, listingId string")
    return ex.parse_pages(ex.normal_captures(df)).first()


def test_snapshot_merges_sources_by_precedence(spark):
    ld = [{"@type": "Thing", "name": "no"}, {"@type": ["A", "lodgingBusiness"], "geo": {"latitude": 0.0, "longitude": "1.5"}, "aggregateRating": {"ratingValue": "4,8"},
          "offers": {"price": 0, "priceCurrency": ""}, "host": {"memberSince": "in 2011"}}]
    row = parsed(spark, PAGE % json.dumps(ld))
    d = row.data
    assert (row.listing_id, row.captured_at, row.status) == ("7", "2026-01-01T00:00:00Z", "ok")
    assert (d.property_type, d.city) == ("Private room", "flat in Greater London, United Kingdom")
    assert (d.guests, d.num_bedrooms, d.num_beds, d.num_baths) == (4.0, 2.0, 3.0, 1.5)
    assert (d.name, d.price, d.currency, d.pricing_details.price_per_night, d.pricing_details.num_of_nights) == ("Nice & new", 80.0, "EUR", 40.0, 2.0)
    assert (d.ratings, d.property_number_of_reviews, d.host_number_of_reviews, d.is_superhost, d.host_year) == (48.0, 12.0, 33.0, True, 2011.0)
    assert (d.lat, d.long, d.details) == (0.0, 1.5, ["5 guests", "Studio"])
    assert "pricing_details.taxes" in row.summary.missing_fields and "pricing_details.num_of_nights" in row.summary.populated_fields
    assert len(row.summary.missing_fields) + len(row.summary.populated_fields) == 34


def test_overview_needs_heading_section_and_list(spark):
    d = parsed(spark, (PAGE % "[]").replace("lgx66tx", "other")).data
    assert (d.property_type, d.city, d.num_beds, d.guests) == (None, None, None, 5.0)


def test_admission(spark):
    rows = [("https://www.airbnb.com/rooms/1", "x" * 1000), ("https://www.airbnb.com/rooms/2", "x" * 999), ("https://www.airbnb.com/rooms/", "x" * 1000),
            ("https://example.com/rooms/3", "x" * 1000), ("http://airbnb.co.uk/ROOMS/4?a", "x" * 2000), ("https://www.airbnb.com/rooms/5", None)]
    got = ex.admitted(spark.createDataFrame(rows, "url string, html string")).select(ex.listing_id_of_url(F.col("url"))).collect()
    assert sorted(r[0] for r in got) == ["1", "4"]


def test_price_for_nights_equals_a_search_from_every_price(spark):
    """The linear cut gives what the plain pattern finds, on random texts of prices, nights, lines and spaces."""
    import random
    import re

    plain = re.compile(fixed.SYMBOL_PATTERN + r"\s?([\d,.]+)(?:\s+|.*?\s+)for\s+(\d+)\s+nights?", re.IGNORECASE)

    def wanted(text):
        for symbol, amount, nights in plain.findall(text):
            try:
                a, n = float(amount.replace(",", "")), float(nights)
            except ValueError:
                continue
            if a > 0 and n > 0:
                return symbol, a, n
        return None

    random.seed(7)
    bits = ["$5", "$ 7.50", "kr", "kr 30", "€\n12", " for 3 nights ", "for 2 night ", " for 0 nights ", "\n", " ", "x", "  \n ", "US$1,200", "$0", "for"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(1, 12))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", price_for_nights(F.col("text")).alias("p")).collect():
        got = (r.p.symbol, r.p.amount, r.p.nights) if r.p else None
        assert got == wanted(r.text), repr(r.text)


def test_a_page_of_prices_takes_linear_time(spark):
    import time

    text = "$5 for 3 nights " + "$10 " * 250_000
    rows = spark.createDataFrame([(text,)], "text string")
    rows.select(price_for_nights(F.lit("$1 for 2 nights")).alias("p")).collect()
    start = time.time()
    assert rows.select(price_for_nights(F.col("text")).alias("p")).first().p.amount == 5
    assert time.time() - start < 10


def _ld(spark, *scripts):
    html = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    page = spark.createDataFrame([("<!-- <script type=\"application/ld+json\">{\"@type\": \"House\", \"name\": \"no\"}</script> -->" + html,)], "html string")
    return page.select(F.inline(jsonld_fields(lodging_blocks(page_elements("html")["jsonld"])))).collect()


def test_host_and_organizer_are_not_mixed(spark):
    both = '{"@type": "House", "host": {"rating": 4.5}, "organizer": {"numberOfReviews": 9, "memberSince": "2011"}}'
    none = '{"@type": "House", "host": {}, "organizer": {"numberOfReviews": 9, "memberSince": "2011"}}'
    first, second = _ld(spark, both, none)
    assert (first.host_rating, first.host_number_of_reviews, first.host_year) == (4.5, None, None)
    assert (second.host_rating, second.host_number_of_reviews, second.host_year) == (None, 9.0, 2011.0)


def test_repeated_keys_keep_the_last_value_and_comments_hold_no_blocks(spark):
    assert [r.name for r in _ld(spark, '{"@type": "House", "name": "a", "name": "b"}', "{broken", '{"@type": "House", "name": "c < d"}')] == ["b", "c < d"]


def test_rejected_markup_is_marked():
    from unittest import mock

    from staygauge.functions import page_elements as step

    assert read_page("<p>fine</p>")["parse_error"] is None
    with mock.patch.object(step, "Outline", side_effect=AssertionError("unknown status keyword")):
        page = read_page("<![x[")
    assert page["parse_error"] == "unknown status keyword" and page["text"] is None


def fits(elements, index, steps):
    """Whether an element completes the steps (relation, condition), by walking up and back from it."""
    if not steps[-1][1](elements[index]):
        return False
    if len(steps) == 1:
        return True
    parent = elements[index][2]
    if steps[-1][0] == "+":
        before = [i for i in range(index) if elements[i][2] == parent]
        return bool(before) and fits(elements, before[-1], steps[:-1])
    while parent >= 0:
        if fits(elements, parent, steps[:-1]):
            return True
        parent = elements[parent][2]
    return False


def test_selectors_in_one_pass():
    import random

    random.seed(2)
    tag = lambda t: lambda e: e[0] == t
    value = lambda v: lambda e: e[1].get("k") == v
    selectors = {
        "a": [(" ", tag("a"))], "[k='1'] b": [(" ", value("1")), (" ", tag("b"))], "[k='1'] + b": [(" ", value("1")), ("+", tag("b"))],
        "a b [k='2'] + a": [(" ", tag("a")), (" ", tag("b")), (" ", value("2")), ("+", tag("a"))],
        "a + b a": [(" ", tag("a")), ("+", tag("b")), (" ", tag("a"))], "b[k='1']": [(" ", lambda e: e[0] == "b" and e[1].get("k") == "1")]}
    compiled = Selectors(list(selectors))
    for _ in range(400):
        parts = [random.choice(["<a>", "<b>", "<a k='1'>", "<b k='1'>", "<b k='2'>", "<br k='2'>", "<a k='1' k='2'/>", "</a>", "</b>", "x"]) for _ in range(25)]
        outline = Outline("".join(parts), compiled)
        for bit, steps in zip(compiled.last, selectors.values(), strict=True):
            assert [i for i, bits in outline.matches if bits & bit] == [i for i in range(len(outline.elements)) if fits(outline.elements, i, steps)]


@pytest.mark.parametrize("html", [
    "<div>" * 100_000 + "x" + "</div>" * 100_000, "<p>" * 40_000 + "</b>" * 40_000, "<div data-testid='review-item'>" + "<p>a" * 50_000,
    "<div data-testid='title'></div><div>" * 30_000, "<section><h2 elementtiming='LCP-target'>a in b</h2>" + "<ol>" * 50_000])
def test_a_page_takes_linear_time(html):
    import time

    start = time.process_time()
    read_page(html)
    assert time.process_time() - start < 4


def test_number_of_reviews(spark):
    page = spark.createDataFrame([("<div data-testid='review-item'>" + "".join(f"<p>r{k}</p>" for k in range(25)) + "</div>",)], "html string")
    got = page.select(F.size(page_elements("html")["reviews"]), F.size(page_elements("html", None)["reviews"]), F.size(page_elements("html", 3)["reviews"])).first()
    assert tuple(got) == (10, 25, 3)


def test_text_and_title_know_the_references_of_their_sql(spark, tmp_path):
    from staygauge.workloads.pages import page_text, page_title

    html = "<h1>a&amp;&amp</h1><p>token = &quot;x&quot;</p><p>b&quo</p>"
    spark.createDataFrame([(1, "u", html), (2, "u", "<h1>&quot;</h1>&eacute;")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, page_text(spark, str(tmp_path)).collect())) == [(1, 'a&&amp token = "x" b&quo'), (2, '" &eacute;')]
    assert sorted(map(tuple, page_title(spark, str(tmp_path)).collect())) == [(1, "a&&amp"), (2, "&quot;")]
    # Pages as such are read as browsers do.
    assert spark.createDataFrame([(html,)], "html string").select(page_elements("html")["title"]).first()[0] == "a&&"


@pytest.mark.parametrize("files", [1, 3])
def test_admitted_stream_reads_a_table_of_one_or_more_files(spark, tmp_path, files):
    from staygauge.workloads.streams import admitted_stream

    rows = [(i, f"https://x.example/{'en' if i % 2 else 'de'}/{i}", "x" * (1000 + i)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(files)
    df.write.parquet(f"{tmp_path}/{'t' if files == 1 else 'pages.parquet'}")
    if files == 1:
        [part] = [f for f in (tmp_path / "t").iterdir() if f.name.endswith(".parquet")]
        part.rename(tmp_path / "pages.parquet")
    assert sorted(int(r[0]) for r in admitted_stream(spark, str(tmp_path)).collect()) == list(range(1, 40, 2))


def test_narrow_rows_are_dealt_by_number(spark):
    from staygauge.session import spread

    assert spread(spark.range(20_000).coalesce(1), "id").rdd.getNumPartitions() == 5
    assert spread(spark.range(20_000).coalesce(1), "id", rows_per_task=1000).rdd.getNumPartitions() == 20
    assert spread(spark.range(3).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_no_task_holds_all_capture_lines(spark, tmp_path):
    """Capture files are written by batch, which sorts a task's pages: their number must not grow with the table."""
    from staygauge.workloads.standins import captured_pages

    spark.range(20_000).selectExpr("id AS c_custkey", "CAST(0 AS INT) AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'here' AS n_name, 0 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 0 AS r_regionkey, 'there' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    tasks = captured_pages(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 20_000 and max(r["count"] for r in tasks) < 6000


def test_capture_lines_are_written_without_a_sort(tmp_path):
    """No task of ``capture_files`` holds pages, so what a task holds does not depend on their number and length."""
    import subprocess
    import sys
    from pathlib import Path

    script = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{tmp_path}/events").config("spark.eventLog.compress", "false").getOrCreate())
spark.range(300).selectExpr("id AS c_custkey", "CAST(0 AS INT) AS c_nationkey").coalesce(1).write.parquet("{tmp_path}/customer.parquet")
spark.sql("SELECT 0 AS n_nationkey, 'here' AS n_name, 0 AS n_regionkey").write.parquet("{tmp_path}/nation.parquet")
spark.sql("SELECT 0 AS r_regionkey, 'there' AS r_name").write.parquet("{tmp_path}/region.parquet")
from staygauge.workloads.pages import capture_files
assert capture_files(spark, "{tmp_path}").count() == 300
spark.stop()
"""
    (tmp_path / "events").mkdir()
    subprocess.run([sys.executable, "-c", script], check=True, cwd=Path(__file__).parents[1])
    events = [json.loads(line) for file in (tmp_path / "events").rglob("*") if file.is_file() for line in file.open() if "SparkListenerTaskEnd" in line]
    writing = [e["Task Metrics"] for e in events if e["Task Metrics"]["Output Metrics"]["Records Written"]]
    assert sum(m["Output Metrics"]["Records Written"] for m in writing) >= 2 * 300
    assert max(m["Peak Execution Memory"] for m in writing) < 4e6  # two lookup tables of 1 MB; a sort takes a page of memory more


def test_a_page_is_searched_once_for_each_fact(spark):
    """A fact that stands in conditions is a column of its own: copied into each of them, its pattern would run there again."""
    captures = spark.createDataFrame([("1", "https://x.example/", None, "<p>Hosting since 2012</p>")], "listing_id string, url string, captured_at string, html string")
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = ex.parse_pages(captures)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    for pattern in (fixed.HOSTING_SINCE, fixed.HOST_RATING, fixed.RESPONSE_RATE, fixed.REVIEW_COUNT + ",", fixed.AMENITY_COUNT):
        assert plan.count(pattern) == 1, pattern


def test_blank_texts_and_empty_numbers_are_missing(spark):
    row = spark.sql("SELECT '\u00a0 \u2003' AS blank, ' a' AS filled, CAST(NULL AS STRING) AS none, 'per night' AS words, '' AS empty").select(
        ex.is_missing(F.col("blank"), "string"), ex.is_missing(F.col("filled"), "string"), ex.is_missing(F.col("none"), "string"),
        ex.parse_number(F.col("words")), ex.parse_number(F.col("empty")), ex.parse_number(F.col("none"))).first()
    assert list(row) == [True, False, True, None, None, None]
