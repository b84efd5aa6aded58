import random

import pytest

from quillon.llm.canonical import Dictionary, bound_for, compact, deletes, distance, expand, fold, mapped

ENTRIES = [(1, "Quiet Hill House", "QHHX"), (2, "Iron Gate University Press", None), (3, "Éditions Salt Row", None), (4, "Amber Tower Books", None)]
BOOKS = Dictionary(ENTRIES, designated=True)
KINDS = Dictionary([(1, "Local History", None), (2, "Law", None), (3, "Cooking", None)], {"Local History": ["hist. - local"], "Cooking": ["cookery"]})


@pytest.mark.parametrize(
    "text, ref",
    [
        ("Quiet Hill House", 1), ("QUIET HILL HOUSE, Ltd.", 1), ("Quiet Hill Hse", 1), ("House Quiet Hill", 1), ("Hill House, Quiet", 1), ("Marlow : Quiet Hill House", 1), ("Quiet Hill House, Marlow", 1), ("qhhx", 1), ("Q.H.H.X.", 1),
        ("QuietHill House", 1), ("Quiet-Hill House", 1), ("The Quiet Hill Co.", 1), ("Quiet Hill", 1), ("Qiuet Hill House", 1), ("© Quiet  Hill House", 1), ("Imprint: Iron Gate Univ. Pr.", 2), ("Salt Row Editions", 3), ("editions salt row", 3),
        ("Quiet Hill Books", -1), ("Iron Gate Press", -1), ("Amber Hill House", -1), ("unknown", -1), ("", -1), ("  ", -1), (None, -1), ("x" * 5000, -1), ("ERT", -1),
    ],
)
def test_publishers(text, ref):
    assert BOOKS.resolve(text) == ref


@pytest.mark.parametrize("text, ref", [("local history", 1), ("Books > Local History", 1), ("All > Adult > Law", 2), ("#law", 2), ("Local_History", 1), ("Local History (general)", 1), ("HIST. - LOCAL", 1), ("Local Histroy", 1), ("cookerry", 3), ("Books", -1), ("La", -1), ("Military History", -1)])
def test_categories(text, ref):
    assert KINDS.resolve(text) == ref


def plain_distance(a, b):
    d = {(i, j): i + j if 0 in (i, j) else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_every_spelling_within_the_bound_is_found():
    """The delete index against brute force over all spellings."""
    rnd = random.Random(7)
    words = sorted(BOOKS.spellings)
    for _ in range(300):
        w = list(rnd.choice(words))
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice([[], [w[i], w[i]], [rnd.choice("abcxyz")]])
        q = "".join(w)
        found = {x for d in deletes(q, bound_for(len(q), 2)) for x in BOOKS.deleted.get(d, ())}
        assert {x for x in words if plain_distance(q, x) <= min(bound_for(len(q), 2), bound_for(len(x), 2))} <= found


def test_weighted_distance():
    assert distance("abc", "abc", 2) == 0
    assert distance("hill", "hilll", 2) < distance("hill", "hillx", 2)
    assert distance("hill", "hikl", 2) < distance("hill", "hiql", 2)
    assert distance("hill", "ihll", 2) == 0.8
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(8))) for _ in range(2))
        n = distance(a, b, 50)
        assert 0.69 * plain_distance(a, b) <= n <= plain_distance(a, b) + 1e-9


def test_stem_of_a_more_frequent_other_house_is_no_match():
    d = Dictionary(ENTRIES, designated=True)
    d.weigh({"ambertowerbooks": 2, "ambertowerpress": 9, "quiethillhouse": 5})
    assert d.resolve("Amber Tower") == -1 and d.resolve("Amber Tower Books") == 4 and d.resolve("Quiet Hill") == 1
    assert compact(expand(fold("Iron Gate Univ. Pr."))) == "irongateuniversitypress"


def test_mapped(spark):
    entries = spark.createDataFrame([(i, "publisher", n, s) for i, n, s in ENTRIES], "ref_id bigint, field_name string, label string, short_form string")
    values = spark.createDataFrame([("publisher", "quiet hill house", 1), ("publisher", None, 2), ("other", "x", 3), ("publisher", "quiet hill house", 4)], "f string, v string, ref int")
    assert {r["ref"]: r["ref_id"] for r in mapped(values, "f", "v", entries).collect()} == {1: 1, 2: -1, 3: -1, 4: 1}
    assert [r["ref_id"] for r in mapped(values, "f", "v", entries.limit(0)).collect()] == [-1] * 4
    assert mapped(values.limit(0), "f", "v", entries).collect() == []
    with pytest.raises(ValueError):
        mapped(values, "f", "v", entries, max_entries=2)


def test_long_values_are_judged_after_cleaning():
    path = "Shelf of Things > " * 40
    assert len(path) > 400 and KINDS.resolve(path + "Cooking") == KINDS.resolve("Shelf > Cooking")
    assert BOOKS.resolve("Marlow " * 80 + ": Quiet Hill House") == BOOKS.resolve("Marlow : Quiet Hill House") == 1


def test_other_names_are_learned_from_rows_about_one_thing(spark):
    """'whodunits' shares no letters with the entry it means; junk that goes with everything is not learned."""
    entries = spark.createDataFrame([(1, "category", "Mystery", None), (2, "category", "Gardening", None), (3, "category", "Poetry", None)], "ref_id bigint, field_name string, label string, short_form string")
    rows = []
    for i in range(6):
        rows += [(2 * i, "category", "Mystery", f"k{i}", 0), (2 * i + 1, "category", "Whodunits", f"k{i}", 0), (2 * i + 1, "category", "staff picks", f"k{i}", 0)]
    for i in range(6, 30):
        other = ["Gardening", "Poetry"][i % 2]
        rows += [(2 * i, "category", other, f"k{i}", 0), (2 * i + 1, "category", "staff picks", f"k{i}", 0)]
    rows += [(99, "category", "whodunit", None, 0), (100, "category", None, "k1", 0), (101, "other", "Mystery", "k1", 0), (102, "category", "Mystery" + " " * 5000, None, 0)]
    df = spark.createDataFrame(rows, "id bigint, f string, v string, k string, _first int")
    got = {(r["id"], r["v"]): r["ref_id"] for r in mapped(df, "f", "v", entries, learn=("id", "k"), learned_fields=("category",)).collect()}
    assert got[(1, "Whodunits")] == 1 and got[(99, "whodunit")] == 1 and got[(1, "staff picks")] == -1 and got[(100, None)] == -1 and got[(101, "Mystery")] == -1 and got[(102, "Mystery" + " " * 5000)] == 1
    assert mapped(df.limit(0), "f", "v", entries, learn=("id", "k")).count() == 0
    assert {r["ref_id"] for r in mapped(df, "f", "v", entries.limit(0), learn=("id", "k")).collect()} == {-1}


def test_workers_keep_answers_apart_by_dictionary():
    from quillon.llm.canonical import _kept

    _kept("a")["x"] = 1
    assert "x" not in _kept("b") and _kept("a")["x"] == 1
