import itertools
import random

import pytest

from quillon.llm.names import read, within_one
from quillon.llm.variants import Trie, identities, same_name_pairs, trie_join


@pytest.mark.parametrize(
    "text, surname, given",
    [
        ("Margaret Halebrook", "halebrook", ("margaret",)), ("Halebrook, Margaret J.", "halebrook", ("margaret", "j")), ("HALEBROOK, M", "halebrook", ("m",)), ("Halebrook MJ", "halebrook", ("m", "j")), ("M.J. Halebrook", "halebrook", ("m", "j")),
        ("Dr. Margaret van der Halebrook, PhD", "halebrook", ("margaret",)), ("Halebrook,Margaret", "halebrook", ("margaret",)), ("*Margaret Halebrook* (Ed.)", "halebrook", ("margaret",)), ("by Margaret Halebrook", "halebrook", ("margaret",)), ("Marg. Halebrook", "halebrook", ("marg.",)),
        ("Jürgen Hälebrook", "halebrook", ("jurgen",)), ("Juergen Halebr0ok", "halebrook", ("juergen",)), ("de Halebrook, Anna", "halebrook", ("anna",)),
    ],
)
def test_read(text, surname, given):
    n = read(text)
    assert (n.surname, n.given) == (surname, given)


def test_organisations_match_in_any_order():
    assert read("Halebrook Writers' Guild").surname == read("Writers' Guild, Halebrook").surname == read("The Halebrook Writers' Guild, Inc.").surname
    assert read("Halebrook Poetry Soc.").surname == read("HALEBROOK POETRY SOCIETY").surname
    assert read("***") is None and read("") is None


def edits(a, b):
    d = {(i, j): i + j if 0 in (i, j) else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def words(n, seed):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(5, 9))) for _ in range(n)})


def test_automaton_against_brute_force():
    own = words(200, 1)
    trie = Trie(own)
    for w in words(60, 2):
        assert set(trie.near(w)) == {x for x in own if edits(w, x) <= 1} == {x for x in own if within_one(w, x)}


def test_trie_join_against_all_pairs(spark):
    own = words(400, 3)
    df = spark.createDataFrame([(w,) for w in [*own, own[0], "ab", None]], "w string")
    got = {tuple(r) for r in trie_join(df, "w").collect()}
    assert got == {(a, b) for a, b in itertools.combinations(own, 2) if edits(a, b) <= 1}


def test_pairs(spark):
    people = {
        "a": ["Margaret Halebrook", "Halebrook, Margaret", "MARGARET HALEBROOK", "M. Halebrook", "Peg Halebrook", "Margaret Halebrok", "Margraet Halebrook", "Margaret J. Halebrook", "Halebrook Margaret", "Marg. Halebrook"],
        "b": ["Robert Stonefield", "Bob Stonefield", "Stonefield, R."],
        "c": ["Gerald Stonefield", "Stonefield, Gerald"],
        "d": ["Halebrook Poetry Society", "Poetry Society, Halebrook"],
        "e": ["Margaret Stoneford", "Stoneford, Margaret"],
    }
    rows = [(p, n) for p, names in people.items() for n in names] + [("f", f"Margaret {x}") for x in ("Underwood", "Winterbourne", "Applegarth")] + [(None, None), (None, "***")]
    rows = [(i, n, p) for i, (p, n) in enumerate([*rows, ("a", "Margaret Halebrook")])]
    df = spark.createDataFrame([(i, n, "x") for i, n, _ in rows], "id bigint, n string, person string")
    got = {tuple(r) for r in same_name_pairs(df, "id", "n").collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] and a[2] != "f" and a[2] == b[2] and a[1] != b[1]}
    assert got == want
    assert same_name_pairs(df.limit(0), "id", "n").count() == 0


def test_frequent_name_costs_one_row(spark):
    df = spark.createDataFrame([("Margaret Halebrook",)] * 500 + [("Halebrook, Margaret",)] * 3, "n string")
    assert identities(df, "n").count() == 2


def test_short_surnames_are_joined_too(spark):
    own = ["reed", "reid", "lee", "leo", "li", "lo", "read", "rede", "ash"]
    got = {tuple(r) for r in trie_join(spark.createDataFrame([(w,) for w in own], "w string"), "w").collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(own), 2) if edits(a, b) <= 1}
    df = spark.createDataFrame([("Margaret Reed",)] * 60 + [("Margaret Reid",)], "n string")
    assert len({r["person"] for r in identities(df, "n").collect()}) == 1


def test_slips_of_slips_come_to_one_person(spark):
    """Each spelling is a slip of the next more frequent one; the ends of the chain are three edits apart."""
    spelled = [("Halebrook", 5000), ("Halebrok", 90), ("Halebrk", 1)]
    df = spark.createDataFrame([(f"Margaret {s}",) for s, n in spelled for _ in range(n)], "n string")
    assert len({r["person"] for r in identities(df, "n").collect()}) == 1


def test_a_turned_name_keeps_all_its_given_names(spark):
    many = " ".join("abcdefghijklm"[i] * 3 + "ora" for i in range(12))
    rows = [("Margaret " + x,) for x in ("Underwood", "Winterbourne", "Applegarth")] * 4 + [(f"{x} Halebrook",) for x in ("Anna", "Clara", "Edith")] * 4 + [(f"Halebrook Margaret {many}",)]
    got = {r["name"]: r["person"] for r in identities(spark.createDataFrame(rows, "n string"), "n").collect()}
    assert len(got) == 7
