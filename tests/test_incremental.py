import random
from datetime import datetime, timedelta

import pytest

from quillon.operators.incremental import Ledger, MerkleTree, due_records, newest_records, taken_over

RECORD = "record_id bigint, source_id string, external_id string, url string, content_hash string, fetched_at timestamp"
LISTING = "book_source_id bigint, source_id string, external_id string, url string, raw_record_id bigint"
T0 = datetime(2025, 1, 1)


def brute(records, listings):
    newest, by_id = {}, {r[0]: r for r in records}
    for r in records:
        key = (r[1], "e", r[2]) if r[2] is not None else (r[1], "u", r[3])
        if key[2] is not None and (key not in newest or (r[5], r[0]) > (newest[key][5], newest[key][0])):
            newest[key] = r
    out = set()
    for key, r in newest.items():
        mine = [x for x in listings if ((x[1], "e", x[2]) if x[2] is not None else (x[1], "u", x[3])) == key]
        known = [by_id[x[4]][4] if x[4] in by_id else None for x in mine]
        if not mine or r[4] is None or any(h is None or h.lower() != r[4].lower() for h in known):
            out.add(r[0])
    return out


def run(spark, records, listings, **kw):
    return sorted(r[0] for r in due_records(spark.createDataFrame(records, RECORD), spark.createDataFrame(listings, LISTING), **kw).collect())


def test_against_brute_force(spark):
    rnd = random.Random(5)
    records = []
    for i in range(1, 400):
        ext = rnd.choice([None, f"x{rnd.randrange(60)}"])
        records.append((i, rnd.choice(["a", "b", "hot", "hot", None]), ext, f"u{rnd.randrange(40)}" if ext is None or rnd.random() < 0.5 else None, rnd.choice(["AA", "aa", "bb", "Bb", "cc", None]), T0 + timedelta(hours=rnd.randrange(100))))
    listings = []
    for i in range(1, 150):
        r = rnd.choice(records)
        listings.append((i, r[1], r[2], r[3], rnd.choice([None, r[0], rnd.randrange(1, 500)])))
    assert run(spark, records, listings) == sorted(brute(records, listings))
    assert run(spark, records, listings, tree=MerkleTree(fanout=2, rows_per_leaf=1)) == sorted(brute(records, listings))


def test_cases(spark):
    records = [(1, "a", "x", None, "AB", T0), (2, "a", None, "u", "cd", T0), (3, "a", "x", None, "ab", T0 + timedelta(1)), (4, "b", "x", None, "ef", T0), (5, "a", "y", "u", "aa", T0), (6, "a", "y", None, "bb", T0 - timedelta(1))]
    listings = [(1, "a", "x", None, 1), (2, "a", None, "u", None), (3, "b", "x", "other", 1), (4, "a", "y", None, 5)]
    assert run(spark, records, listings) == [2, 4]
    assert run(spark, [], listings) == []
    assert run(spark, records, []) == [2, 3, 4, 5]


def test_equal_states_have_equal_trees_and_nothing_below_is_read(spark):
    records = spark.createDataFrame([(i, "a", f"x{i}", None, f"h{i}", T0) for i in range(200)], RECORD)
    state = newest_records(records).select("key", "state")
    tree = MerkleTree(fanout=4, rows_per_leaf=4).sized_for(200)
    whole = tree.tree(tree.leaves(state))
    assert tree.changed_leaves(whole, tree.tree(tree.leaves(state.repartition(3)))).count() == 0
    assert whole.where("level = 0").count() == 1
    other = tree.tree(tree.leaves(newest_records(records.where("record_id <> 7")).select("key", "state")))
    assert tree.changed_leaves(whole, other).count() == 1


def test_runs_survive_a_failure_and_repeat_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    records = [(i, "a", f"x{i}", None, f"h{i}", T0) for i in range(50)]
    with pytest.raises(RuntimeError):
        ledger.run(spark.createDataFrame(records, RECORD), fail_before_commit=True)
    assert ledger.current() is None
    assert ledger.run(spark.createDataFrame(records, RECORD)).count() == 50
    assert ledger.run(spark.createDataFrame(records, RECORD)).count() == 0
    late = [*records, (60, "a", "x1", None, "old", T0 - timedelta(5)), (61, "a", "x2", None, "new", T0 + timedelta(1)), (62, "a", "x3", None, "H3", T0 + timedelta(1))]
    with pytest.raises(RuntimeError):
        ledger.run(spark.createDataFrame(late, RECORD), fail_before_commit=True)
    assert [r["record_id"] for r in ledger.run(spark.createDataFrame(late, RECORD)).collect()] == [61]


def test_a_run_rewrites_only_changed_buckets_and_grows_its_tree(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), rows_per_bucket=40)
    records = [(i, "a", f"x{i}", None, f"h{i}", T0) for i in range(400)]
    assert ledger.run(spark.createDataFrame(records, RECORD)).count() == 400
    first = ledger.current()
    assert first["buckets"] == 8 and len(first["state"]) == 8
    changed = [*records, (1000, "a", "x1", None, "new", T0 + timedelta(1))]
    assert [r["record_id"] for r in ledger.run(spark.createDataFrame(changed, RECORD)).collect()] == [1000]
    second = ledger.current()
    assert sum(first["state"][b] == second["state"][b] for b in first["state"]) == 7 and sum(first["tree"][b] == second["tree"][b] for b in first["tree"]) == 7
    assert ledger.state(second).count() == 400
    more = [*changed, *[(2000 + i, "a", f"y{i}", None, "h", T0) for i in range(2500)]]
    assert ledger.run(spark.createDataFrame(more, RECORD)).count() == 2500 and ledger.current()["depth"] == 2
    assert ledger.run(spark.createDataFrame(more, RECORD)).count() == 0
    assert ledger.run(spark.createDataFrame(more[10:20], RECORD)).count() == 0 and ledger.state(ledger.current()).count() == 2900


def test_a_ledger_that_adopts_listings_finds_what_the_plain_comparison_finds(spark, tmp_path):
    rnd = random.Random(6)
    records = [(i, rnd.choice(["a", "b", None]), f"x{rnd.randrange(60)}", None, rnd.choice(["AA", "aa", "bb", None]), T0 + timedelta(hours=rnd.randrange(100))) for i in range(1, 300)]
    listings = [(i, r[1], r[2], r[3], rnd.choice([None, r[0], 9999])) for i, r in enumerate(rnd.choices(records, k=90))]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    raw = spark.createDataFrame(records, RECORD)
    ledger.adopt(taken_over(spark.createDataFrame(listings, LISTING), raw))
    assert sorted(r["record_id"] for r in ledger.run(raw).collect()) == sorted(brute(records, listings))
    unknown = {r["record_id"] for r in newest_records(raw).where("state is null").collect()}
    assert {r["record_id"] for r in ledger.run(raw).collect()} == unknown
