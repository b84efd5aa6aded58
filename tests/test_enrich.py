from pyspark.sql import functions as F

from quillon.operators import enrich
from quillon.sources import html

FACTS = "author_id int, kind string, value string, source_id string, source_url string, confidence double, place int"


def test_merge_prefers_confidence_then_the_chain(spark):
    rows = [(1, "website", "https://b", "b", None, 0.75, 1), (1, "website", "https://a", "a", None, 0.95, 2), (1, "website", "https://c", "c", None, 0.95, 3), (1, "email", "A@x.org", "a", None, 0.7, 1), (1, "email", "a@x.org", "b", None, 0.8, 2), (1, "email", "b@x.org", "b", None, 0.6, 2), (2, "email", "c@x.org", "b", None, 0.5, 1)]
    got = {(r["author_id"], r["kind"], r["value"], r["source_id"]) for r in enrich.merged_facts(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {(1, "website", "https://a", "a"), (1, "email", "a@x.org", "b"), (1, "email", "b@x.org", "b")}
    assert enrich.merged_facts(spark.createDataFrame([], FACTS)).count() == 0


def test_values_are_cut_before_they_are_compared(spark):
    facts = spark.createDataFrame([(1, "bio", "x" * 600, "a", None, 0.9, 1)], FACTS)
    kept = enrich.merged_facts(facts)
    assert enrich.new_contacts(enrich.merged_facts(facts), kept).count() == 0


def test_only_an_equal_name_is_taken(spark):
    authors = spark.createDataFrame([(1, "Ann Ray"), (2, "Bo Lind")], "author_id int, name string")
    docs = spark.createDataFrame([(1, 0, "Anna Raye", "X"), (1, 1, "RAY, Ann", "Y"), (1, 2, "Ann Ray", "Z"), (2, 7, "Bo Lind", "W")], "author_id int, place int, label string, candidate string")
    assert [tuple(r) for r in enrich.best_match(authors, docs, "author_id", "name").collect()] == [(1, "Y")]


def test_only_people_who_write(spark):
    df = spark.createDataFrame([(["Q5"], ["Q36180"]), (["Q5"], ["Q937857"]), (["Q7725634"], ["Q36180"]), (["Q5"], None)], "i array<string>, o array<string>")
    assert [r[0] for r in df.select(enrich.plausible(F.col("i"), F.col("o"), "Q5", ["Q36180"])).collect()] == [True, False, False, False]


def test_gaps(spark):
    authors = spark.createDataFrame([(1, "", "b"), (2, "w", None), (3, None, None)], "author_id int, website string, bio string")
    facts = spark.createDataFrame([(1, "website", "x"), (2, "website", "y"), (2, "bio", "z")], "author_id int, kind string, value string")
    assert sorted(map(tuple, enrich.fill_gaps(authors, facts, ["website", "bio"]).collect())) == [(1, "x", "b"), (2, "w", "z"), (3, None, None)]


PAGE = """<dl><dt>Pages</dt><dd>300</dd><dt>Pages:</dt><dd>9</dd></dl><table><tr><th>Format</th><td>Paperback</td></tr></table><ul><li>Series: Gate</li></ul>
<a href="mailto:hello@hale.example?subject=x">mail</a><p>info@shop.example or ann@shop.example, https://x.com/hale_m</p>
<div class="reviews"><div class="review">%s</div><div class="review">%s</div><div class="review">short</div></div>""" % ("good " * 20, "good " * 20)


def test_page_details(spark):
    pages = spark.createDataFrame([("https://www.hale.example/a", PAGE), ("https://b.example", None)], "url string, html string")
    fields = {r["url"]: r["fields"] for r in html.labelled_fields(pages).collect()}
    assert fields["https://www.hale.example/a"] == {"pages": "300", "format": "Paperback", "series": "Gate"} and fields["https://b.example"] == {}
    contacts = {r["url"]: r for r in html.contacts_of_pages(pages).collect()}
    assert contacts["https://www.hale.example/a"]["emails"] == ["hello@hale.example", "ann@shop.example"]
    assert contacts["https://www.hale.example/a"]["socials"] == {"twitter": "https://x.com/hale_m"}
    assert {r["url"]: len(r["reviews"]) for r in html.community_reviews(pages).collect()} == {"https://www.hale.example/a": 1, "https://b.example": 0}


LIST = """<nav class="menu"><li class="item">Home</li></nav><div class="book-card"><h3>Quiet Sea</h3><p>by Ann Raymond and Bo Lindqvist</p></div>
<div class="book-card"><h3>Quiet Sea</h3></div><li class="item"><a href="/b/2">Iron Gate By Cy Orrmond</a> $9.99</li><div class="card"><a href="/n">Our summer news</a></div>
<article class="result"><h2>Salt Row</h2> ISBN 978-0-306-40615-7</article>"""


def test_cards(spark):
    pages = spark.createDataFrame([("https://a.example/list", LIST), (None, None)], "url string, html string")
    got = {r["title"]: r for r in html.cards_of_pages(pages).collect()}
    assert set(got) == {"Quiet Sea", "Iron Gate", "Salt Row"}
    assert got["Quiet Sea"]["authors"] == ["Ann Raymond", "Bo Lindqvist"] and got["Iron Gate"]["url"] == "https://a.example/b/2"
    assert got["Salt Row"]["isbn13"] == "9780306406157" and got["Iron Gate"]["price"] == "$9.99"
    reasons = {r["text"]: r["reason"] for r in html.cards_of_pages(pages, explain=True).collect()}
    assert "Our summer news" in reasons and "Home" not in reasons


def test_author_page(spark):
    page = '<h1>Ann Raymond</h1><div class="bio">Born by the sea.</div><dl><dt>Born</dt><dd>1970</dd></dl><p>12 books</p>'
    pages = spark.createDataFrame([("https://a.example/author/1", page), ("https://a.example/x", "<h1>Summer Sale</h1>")], "url string, html string")
    rows = html.author_pages(pages).collect()
    assert [(r["name"], r["bio"], r["fields"], r["books"]) for r in rows] == [("Ann Raymond", "Born by the sea.", {"born": "1970"}, 12)]


def test_biographies_stay_whole(spark):
    rows = [(1, "bio", "b" * 1200, "a", None, 0.9, 1), (1, "website", "w" * 1200, "a", None, 0.9, 1), (1, "email", "e" * 1200, "a", None, 0.9, 1)]
    got = {r["kind"]: len(r["value"]) for r in enrich.merged_facts(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {"bio": 1200, "website": 500, "email": 500}


def test_places_beyond_int(spark):
    far = 2**31 + 5
    rows = spark.createDataFrame([("ann", far + 1, "late@x.org", "https://late"), ("ann", far, "ann@x.org", "https://ann")], "name string, id long, email string, website string")
    facts = enrich.facts_of(rows, "name", F.lit("a"), F.lit(None).cast("string"), F.lit(0.9), F.col("id"), {"website": F.col("website")})
    social = enrich.social_facts(rows.withColumn("s", F.create_map(F.lit("x"), F.col("email"))), "name", "s", F.lit("a"), F.lit(None).cast("string"), F.lit(0.9), F.col("id"))
    assert [(r["value"], r["place"]) for r in enrich.merged_facts(facts).collect()] == [("https://ann", far)]
    assert [(r["value"], r["place"]) for r in enrich.merged_facts(social).collect()] == [("ann@x.org", far)]
