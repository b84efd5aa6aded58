from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillon.llm.survivor import closed, real_date, real_pages, real_text, survivors, transitions

SCHEMA = "id bigint, k string, publisher string, pages int, day date, src string, seen timestamp, _n int"
T = lambda d: datetime(2025, 1, d)
FIELDS = lambda: {"publisher": real_text(F.col("publisher")), "pages": real_pages(F.col("pages")), "day": real_date(F.col("day"))}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    trust = spark.createDataFrame([("hi", 0.9), ("lo", 0.1)], "source string, trust double")
    return {(r["k"], r["field_name"]): r["id"] for r in survivors(df, "k", "id", "src", "seen", trust, FIELDS(), **kw).collect()}


@pytest.mark.parametrize("value, real", [("Hale House", True), ("", False), ("  ", False), (None, False), ("N.A.", False), ("Unknown publisher", False), ("Hale Ho…", False), ("Hale Ho ...", False), ("???", False), ("xxx", False), ("HHX", True)])
def test_real_text(spark, value, real):
    assert spark.createDataFrame([(value,)], "x string").select(real_text(F.col("x"))).first()[0] is real


def test_trust_then_time(spark):
    rows = [
        (1, "k", "A", 100, date(2020, 1, 1), "lo", T(9)), (2, "k", "B", 0, date(1970, 1, 1), "hi", T(1)), (3, "k", "C", 9999, None, "hi", T(2)), (4, "k", "n/a", None, None, "hi", T(3)),
        (5, "one", "A", 100, date(2020, 1, 1), "hi", T(1)), (6, None, "A", 1, None, "hi", T(1)), (7, None, "A", 1, None, "hi", T(1)), (8, "none", "-", 1, date(9999, 12, 31), "hi", T(1)), (9, "none", None, -5, None, "hi", T(1)),
    ]
    assert run(spark, rows) == {("k", "publisher"): 3, ("k", "pages"): 1, ("k", "day"): 1}
    assert run(spark, []) == {}


def test_unknown_source_and_ties(spark):
    rows = [(2, "k", "A", 100, None, "new", T(1)), (1, "k", "B", 100, None, "new", T(1)), (3, "k", "C", None, None, None, T(5))]
    assert run(spark, rows) == {("k", "publisher"): 1, ("k", "pages"): 1}


def test_currency_orders_values_without_time(spark):
    """Elsewhere 'Old' is replaced by 'New' again and again; among untimed rows New comes out on top."""
    rows = [x for i in range(5) for x in ((10 * i + 100, f"g{i}", "Old", None, None, "hi", T(1)), (10 * i + 101, f"g{i}", "New", None, None, "hi", T(2)))]
    rows += [(1, "u", "New", None, None, "hi", None), (2, "u", "Old", None, None, "hi", None), (3, "u", "Old", None, None, "hi", T(3))]
    assert run(spark, rows)[("u", "publisher")] == 1


def test_transitions_cross_quarters(spark):
    rows = [("k", "a", datetime(2025, 1, 1)), ("k", "b", datetime(2025, 7, 1)), ("k", "b", datetime(2025, 7, 2)), ("k", "c", None)]
    df = spark.createDataFrame(rows, "k string, v string, t timestamp")
    assert [tuple(r) for r in transitions(df, ["k"], "v", "t").collect()] == [("a", "b")]


def test_closure_follows_chains_and_drops_circles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")]
    got = {tuple(r) for r in closed(spark.createDataFrame(rows, "older string, newer string")).collect()}
    chain = {(a, b) for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]}
    assert got == chain | {("x", "w"), ("y", "w"), ("z", "w")}
    assert closed(spark.createDataFrame([], "older string, newer string")).count() == 0


def test_precedence_needs_significance(spark):
    rows = [(f"k{i}", v, datetime(2025, 1, d)) for i in range(4) for v, d in (("a", 1), ("b", 2))] + [("m", "b", T(1)), ("m", "c", T(2))]
    df = spark.createDataFrame(rows, "k string, v string, t timestamp")
    assert [tuple(r) for r in transitions(df, ["k"], "v", "t", significance=2.0).collect()] == [("a", "b")]


def test_topologically_latest_by_a_chain_of_learned_steps(spark):
    """Old became Mid and Mid became New in other groups; no group went from Old to New, and no time orders this one."""
    rows = []
    for i in range(6):
        rows += [(100 + i, f"g{i}", "Old House", None, None, "hi", T(1)), (200 + i, f"g{i}", "Mid House", None, None, "hi", T(2))]
        rows += [(300 + i, f"h{i}", "Mid House", None, None, "hi", T(1)), (400 + i, f"h{i}", "New House", None, None, "hi", T(2))]
    rows += [(1, "u", "Old House", None, None, "hi", T(9)), (2, "u", "New House", None, None, "hi", None), (3, "u", "Other", None, None, "hi", None)]
    rows += [(4, "w", "New House", None, None, "hi", T(1)), (5, "w", "Old House", None, None, "hi", None), (6, "w", "Odd", None, None, "lo", None)]
    got = run(spark, rows)
    assert got[("u", "publisher")] == 2 and got[("w", "publisher")] == 4
