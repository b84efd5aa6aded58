import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import crawlplan, leads, merge, resolve
from quillon.operators.normalize import content_hash, normalize_books


def raw(spark, *rows):
    from quillon.sources.api import AUTHOR

    schema = f"raw_id bigint, source_id string, title string, authors array<{AUTHOR}>, subtitle string, external_id string, url string, isbn13 string, isbn10 string, published_date string, publisher string, language string, page_count int, description string, cover_url string, categories array<string>, ratings_count int, average_rating double, price string, raw string, fetched_at timestamp"
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def person(name, **kw):
    return tuple(({"name": name, "role": None} | kw).get(k) for k in ("name", "role", "url", "bio", "email", "website", "socials", "external_id"))


def test_normalized_book(spark):
    df = raw(
        spark,
        {"raw_id": 1, "source_id": "s", "title": " <b>The Sea</b> ", "authors": [person("Dr. Ann Ray", email="A@X.org", url="https://s.example/ann"), person("RAY, ANN"), person("x")], "isbn13": "0306406152", "published_date": "1200", "categories": ["a", "", "a", "b"]},
        {"raw_id": 2, "source_id": "s", "title": "<i> </i>"},
        {"raw_id": 3, "source_id": "s", "title": "The Sea", "authors": [person("Ann Ray")]},
    )
    got = {r["raw_id"]: r for r in normalize_books(df, 2026).collect()}
    assert set(got) == {1, 3}
    b = got[1]
    assert (b["title"], b["isbn13"], b["isbn10"], b["published_year"], b["categories"]) == ("The Sea", "9780306406157", "0306406152", None, ["a", "b"])
    assert [(a["display_name"], a["email"], a["website"], a["position"]) for a in b["authors"]] == [("Dr. Ann Ray", "a@x.org", "https://s.example/ann", 0)]
    assert b["dedupe_key"] == "isbn:9780306406157" and got[3]["dedupe_key"] == "t:sea|a:ray:a"


def test_content_hash_ignores_the_payload(spark):
    df = raw(spark, {"raw_id": 1, "source_id": "s", "title": "t", "raw": "x", "price": "1"}, {"raw_id": 2, "source_id": "s", "title": "t", "raw": "y", "price": "1"}, {"raw_id": 3, "source_id": "s", "title": "t", "price": "2"})
    a, b, c = [r["h"] for r in df.orderBy("raw_id").select(content_hash(df).alias("h")).collect()]
    assert a == b != c


def test_folds(spark):
    df = spark.createDataFrame([("k", 1, None, 0, 5, None, ["b", "a"]), ("k", 2, "", 7, 9, 3.0, ["c", "b"]), ("k", 3, "x", 8, 9, 4.0, None), ("k", 4, "y", 9, 8, 5.0, ["d", None])], "k string, n int, p string, pages int, ratings_count int, average_rating double, c array<string>")
    assert tuple(merge.fold_first(df, "k", ["n"], ["p", "pages"]).first()) == ("k", "x", 7)
    assert merge.fold_arrays(df, "k", ["n"], "c").first()["c"] == ["b", "a", "c", "d"]
    assert merge.fold_arrays(df, "k", ["n"], "c", cap=2).first()["c"] == ["b", "a"]
    r = merge.fold_ratings(df, "k", ["n"]).first()
    assert (r["ratings_count"], r["average_rating"]) == (9, 3.0)
    assert merge.fold_first(df.limit(0), "k", ["n"], ["p"]).count() == 0


def test_upsert_keeps_status_and_refreshes_score(spark):
    old = spark.createDataFrame([(1, 10.0, "won"), (2, 20.0, "new")], "id int, score double, status string")
    new = spark.createDataFrame([(2, 30.0, "new"), (3, 5.0, "new"), (1, None, "new")], "id int, score double, status string")
    assert sorted(map(tuple, merge.upsert(old, new, ["id"], ["score"], ["status"]).collect())) == [(1, None, "won"), (2, 30.0, "new"), (3, 5.0, "new")]


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_ratios():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert resolve.lcs(a, b) == slow_lcs(a, b)
    assert round(resolve.indel_ratio("jane smith", "joan smith"), 1) == 90.0
    assert round(resolve.indel_ratio("jon smith", "john smith"), 2) == 94.74
    assert resolve.names_agree("ann ray", "ann mary ray") == 0.0  # lengths differ by half
    assert resolve.names_agree("margaret hale", "margaret ann hale") >= 92
    assert resolve.names_agree("", "x") == 0.0


def test_authors_are_resolved_in_order_of_arrival(spark):
    rows = [("smith:j", "jon smith", 1), ("smith:j", "john smith", 2), ("smith:j", "jane smith", 3), ("smith:j", "joan smith", 4), ("hale:m", "m hale", 5), ("smith:j", "jon smith", 6), ("x", None, 7)]
    df = spark.createDataFrame(rows, "b string, n string, seq int")
    got = {(r["block"], r["name"]): r["author_name"] for r in resolve.resolve_authors(df, "b", "n", "seq").collect()}
    assert got == {("smith:j", "jon smith"): "jon smith", ("smith:j", "john smith"): "jon smith", ("smith:j", "jane smith"): "jane smith", ("smith:j", "joan smith"): "jon smith", ("hale:m", "m hale"): "m hale"}


def test_books_against_one_sequential_shelf(spark):
    """Components are independent: resolving each alone equals one pass over everything."""
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        word = rnd.choice(["quiet sea", "quiet seas", "loud hill", "iron gate of the north", "iron gate of the nort"])
        blocks = rnd.sample(["a:x", "b:y", "c:z", "d:w"], rnd.randrange(3))
        isbn = rnd.choice([None, None, f"97800000000{rnd.randrange(8)}0"])
        key = f"isbn:{isbn}" if isbn else f"t:{word}|a:{blocks[0] if blocks else ''}"
        rows.append((i, word, isbn, key, [(b,) for b in blocks]))
    df = spark.createDataFrame(rows, "id bigint, title string, isbn13 string, dedupe_key string, authors array<struct<dedupe_key:string>>")
    got = {r["id"]: r["book"] for r in resolve.resolve_books(df, "id").collect()}
    shelf, first, want = resolve.BookShelf(), {}, {}
    for i, title, isbn, key, authors in rows:
        at = shelf.place(title, isbn, key, authors[0][0] if authors else None, [a[0] for a in authors])
        want[i] = first.setdefault(at, i)
    assert got == want


def test_signals(spark):
    df = spark.createDataFrame([("2026-05-01", None, 3, 25, 2, True)], "d string, y int, n int, r int, c int, s boolean").withColumn("d", F.col("d").cast("date"))
    sig = {"recency": leads.recency(F.col("d"), F.col("y"), (2026, 11), 36), "small_catalogue": leads.small_catalogue(F.col("n")), "low_visibility": leads.low_visibility(F.col("r")), "contactable": leads.contactable(F.col("c"), F.col("s"))}
    row = df.select(*[c.alias(k) for k, c in sig.items()], leads.reasons(sig, leads.PROFILES["services"][1]).alias("why"), leads.tier(F.lit(54.99)).alias("t")).first()
    assert (round(row["recency"], 4), row["small_catalogue"], row["low_visibility"], row["contactable"], row["t"]) == (0.8333, 0.6, 0.5, 1.0, "C")
    assert [w["signal"] for w in row["why"]] == ["recency", "contactable", "small_catalogue", "low_visibility"]
    unknown = df.select(leads.recency(F.lit(None).cast("date"), F.lit(None).cast("int"), (2026, 11), 36).alias("x")).first()["x"]
    assert unknown == 0.3
    for _, weights in leads.PROFILES.values():
        assert sum(weights.values()) == pytest.approx(1.0)


def test_suppression_reasons_in_order(spark):
    rows = spark.createDataFrame([(1, "A@x.org", "Ann"), (2, "b@Y.org", "Bo"), (3, "c@z.org", " CY "), (4, None, "Di"), (5, "", None)], "id int, email string, name string")
    lists = spark.createDataFrame([("email", " a@x.org"), ("domain", "@y.org"), ("author_name", "cy"), ("author_name", "ann"), ("email", "A@X.ORG")], "kind string, value string")
    got = {r["id"]: r["suppression_reason"] for r in leads.suppressed(rows, lists, ["email"], "name").collect()}
    assert got == {1: "email", 2: "domain", 3: "author_name", 4: None, 5: None}


def test_rate_limit_equals_the_recurrence(spark):
    rnd = random.Random(2)
    t0 = datetime(2025, 1, 1)
    rows = [(i, rnd.choice("ab"), t0 + timedelta(seconds=rnd.randrange(30))) for i in range(80)]
    got = {r["i"]: r["allowed_s"] for r in crawlplan.rate_limited(spark.createDataFrame(rows, "i int, h string, t timestamp"), "h", "t", "i", 2.0).collect()}
    free = {}
    for i, h, t in sorted(rows, key=lambda r: (r[2], r[0])):
        at = max((t - datetime(1970, 1, 1)).total_seconds(), free.get(h, 0.0))
        free[h] = at + 2.0
        assert got[i] == pytest.approx(at)


def test_circuit_breaker_equals_the_loop(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("abc"), rnd.random() < 0.5) for i in range(150)]
    got = {r["i"]: r["skipped"] for r in crawlplan.circuit_breaker(spark.createDataFrame(rows, "i int, h string, bad boolean"), "h", ["i"], "bad").collect()}
    streak, dead = {}, set()
    for i, h, bad in rows:
        assert got[i] == (h in dead)
        streak[h] = streak.get(h, 0) + 1 if bad else 0
        if streak[h] >= 3:
            dead.add(h)


def test_title_index_against_all_pairs():
    """The index finds what comparing every title finds, at all lengths."""
    import random

    from quillon.operators.resolve import TitleIndex, indel_ratio

    rnd = random.Random(3)
    for least in (80.0, 94.0):
        index, titles = TitleIndex(least), []
        for k in range(150):
            t = "".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 1, 2, 4, 9, 20, 45])))
            t = rnd.choice(titles)[: rnd.randrange(1, 60)] + rnd.choice(["", "a", "b"]) if titles and rnd.random() < 0.5 else t
            assert index.near(t) == [i for i, x in enumerate(titles) if indel_ratio(t, x) >= least]
            index.add(t, k)
            titles.append(t)


def test_leads_need_a_known_profile(spark):
    from quillon.operators.exporting import scored_leads

    with pytest.raises(ValueError):
        scored_leads(None, None, None, "nothing", (2026, 1), [], [])


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    from quillon.operators import graph

    rnd, writes = random.Random(1), []

    def counted(f):
        def call(df, *args):
            writes.append(1)
            assert len(writes) < 25
            return f(df, *args)

        return call

    for name in ("stage", "cut"):
        if hasattr(graph, name):
            monkeypatch.setattr(graph, name, counted(getattr(graph, name)))
    chain = rnd.sample(range(1000, 1150), 150)
    edges = [*zip(chain, chain[1:]), (1, 2), (3, 3), (5, None)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: min(chain) for x in chain} | {1: 1, 2: 1, 3: 3, 5: 5}
