"""Names typed in many ways that mean the same person or organisation.

1. Every distinct name is read once into surname, given names and short form (module names).
2. Which part is the surname, where the text leaves it open ("Hale Margaret"), follows from how often its parts occur
   in first and in last place over all names.
3. Within a surname, initials, cut forms, short forms and mistyped given names are put to the full given name they fit;
   one that fits several goes to the one with the most rows if there is one, else it stays on its own.
4. Mistyped surnames and organisations are found by a trie join: the surnames are sharded by a shared beginning or end
   (one edit leaves one of the two halves as it is), each shard is a trie, and a Levenshtein automaton walks it with
   each of its words. Two people of neighbouring surnames are one if their given names agree and the rarer surname is
   rare enough to be a slip.

Rows of equal names are counted before anything is shuffled, so frequent names cost as much as rare ones; nothing
compares all pairs of a group.

Defined cases: null names and names without letters belong to nobody; names compare exactly in the result, so equal
ones give no pair; organisations match on their words in any order; a name without a given name matches its equals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.names import NICKNAMES, read, within_one
from quillon.operators.graph import components
from quillon.session import stage


class Trie:
    """Words with a walk that finds those within one edit (swaps of neighbours count as one)."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, bound: int = 1) -> Iterator[str]:
        """Walks the trie with the automaton of `word`: a state is the row of edit distances to the word's beginnings,
        and a branch is left as soon as no entry of its row is within the bound."""
        start = list(range(len(word) + 1))
        stack = [(self.root, start, None, "")]
        while stack:
            node, row, above, last = stack.pop()
            if "" in node and row[-1] <= bound:
                yield node[""]
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j, x in enumerate(word, 1):
                    best = row[j - 1] if x == c else 1 + min(row[j - 1], row[j], new[j - 1])
                    if above is not None and j > 1 and x == last and word[j - 2] == c:
                        best = min(best, above[j - 2] + 1)
                    new.append(best)
                if min(new) <= bound or (above is None and min(row) <= bound) or min(row) <= bound - 1:
                    stack.append((child, new, row, c))


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def trie_join(words: DataFrame, col: str, min_length: int = 2) -> DataFrame:
    """(a, b): the pairs of distinct words, a < b, one edit apart; words shorter than min_length have none."""
    n = F.length("w")
    halves = F.array_distinct(F.array(F.floor((n - 1) / 2).cast("int"), F.floor((n - 2) / 2).cast("int")))
    keyed = words.select(F.col(col).alias("w")).where(F.length(col) >= min_length).distinct().select("w", F.explode(halves).alias("h"))
    ends = F.array(F.concat_ws("-", F.lit("p"), "h", F.expr("left(w, h)")), F.concat_ws("-", F.lit("s"), "h", F.expr("right(w, h)")))
    keyed = keyed.select(F.explode(ends).alias("shard"), "w")
    # a stated number of partitions is not coalesced: the shards are small in bytes, but not in work
    sharded = keyed.repartition(_tasks(words), "shard").sortWithinPartitions("shard")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, shard = None, []

        def pairs(shard: list[str]) -> list[tuple[str, str]]:
            if len(shard) == 2:
                x, y = sorted(shard)
                return [(x, y)] if x != y and within_one(x, y) else []
            trie = Trie(shard)
            return [(w, x) for w in shard for x in trie.near(w) if w < x]

        for df in batches:
            found: list[tuple[str, str]] = []
            for key, w in zip(df["shard"].to_numpy(), df["w"].to_numpy()):
                if key != at:
                    if len(shard) > 1:
                        found += pairs(shard)
                    at, shard = key, []
                shard.append(w)
            yield pd.DataFrame(found, columns=["a", "b"])
        if len(shard) > 1:
            yield pd.DataFrame(pairs(shard), columns=["a", "b"])

    return sharded.mapInPandas(join, "a string, b string").distinct()


def parsed_names(rows: DataFrame, name_col: str) -> DataFrame:
    """(name, n, surname, given, nick, grp, sure): each distinct name once, read, with its number of rows; the order of
    its parts settled."""
    counted = rows.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.count("*").alias("n"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(name, n, *p) for name, n in zip(df["name"], df["n"]) if (p := read(name))]
            frame = pd.DataFrame(out, columns=["name", "n", "surname", "given", "nick", "grp", "sure"])
            yield frame.assign(given=frame["given"].map(list))

    names = stage(counted.repartition(_tasks(counted), "name").mapInPandas(parse, "name string, n long, surname string, given array<string>, nick string, grp boolean, sure boolean"))
    person = names.where("not grp")
    full = F.col("given")[0]
    first = person.where("size(given) > 0").select(full.alias("t"), F.col("n").alias("f"), F.lit(0).cast("long").alias("l"))
    last = person.select(F.col("surname").alias("t"), F.lit(0).cast("long").alias("f"), F.col("n").alias("l"))
    places = first.unionByName(last).where("length(t) > 2").groupBy("t").agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    places = stage(places)
    unsure = names.where("not grp and not sure and size(given) > 0 and length(given[0]) > 2")
    a = places.select(F.col("t").alias("ta"), F.col("f").alias("fa"), F.col("l").alias("la"))
    b = places.select(F.col("t").alias("tb"), F.col("f").alias("fb"), F.col("l").alias("lb"))
    judged = unsure.join(a, full == F.col("ta"), "left").join(b, F.col("surname") == F.col("tb"), "left")
    turned = (F.coalesce("fb", F.lit(0)) + 0.5) * (F.coalesce("la", F.lit(0)) + 0.5) > (F.coalesce("fa", F.lit(0)) + 0.5) * (F.coalesce("lb", F.lit(0)) + 0.5)
    rotated = F.concat(F.slice("given", F.lit(2), F.greatest(F.size("given"), F.lit(1))), F.array("surname"))
    judged = judged.select("name", "n", F.when(turned, full).otherwise(F.col("surname")).alias("surname"), F.when(turned, rotated).otherwise(F.col("given")).alias("given"), "nick", "grp", "sure")
    rest = names.where("grp or sure or size(given) = 0 or length(given[0]) <= 2")
    return stage(rest.unionByName(judged))


def _profiles():
    """The names of one surname, each put to the profile (a given name) it fits."""

    def resolve(members: list[tuple]) -> list[str]:
        """members: (given, nick, n, common, formal, quoted) of the distinct names of one surname: its given names, short
        form and rows, the rows of its first given name under any surname, the full forms of that name and of the short
        form. Their profiles."""
        full: Counter = Counter()
        common: dict[str, int] = {}
        nicks: dict[str, set[str]] = {}
        middles: dict[str, Counter] = {}
        for given, _, n, count, formal, _ in members:
            if len(given) and len(given[0]) > 2 and not given[0].endswith("."):
                full[given[0]] += n
                common[given[0]] = count
                if formal:
                    nicks[given[0]] = set(formal)
                for m in given[1:]:
                    middles.setdefault(given[0], Counter())[m[0]] += n
        shorts: dict[str, list[str]] = {}
        for g in nicks:
            for x in nicks[g]:
                shorts.setdefault(x, []).append(g)
        trie = Trie(list(full)) if len(full) > 1 else None
        # slips and short forms of a full given name
        root: dict[str, str] = {}
        for g in sorted(full, key=lambda g: (common[g], full[g], g)):
            formal = {x for x in nicks.get(g, ()) if x in full and x != g}
            formal |= {x for f in nicks.get(g, ()) for x in shorts[f] if x != g and (full[x], x) > (full[g], g)}
            if formal:
                root[g] = max(formal, key=lambda x: (full[x], x))
                continue
            mine = common[g]
            near = [x for x in (trie.near(g) if trie else ()) if x != g and x not in root and (mine <= 1 or 3 * mine <= common[x]) and (common[x], full[x], x) > (mine, full[g], g)]
            if near:
                root[g] = max(near, key=lambda x: (common[x], full[x], x))
        for g in list(root):
            seen = {g}
            while root[g] in root and root[g] not in seen:
                seen.add(root[g])
                root[g] = root[root[g]]
        weight: Counter = Counter()
        for g, n in full.items():
            weight[root.get(g, g)] += n
        letters: dict[str, list[str]] = {}
        for g in weight:
            letters.setdefault(g[0], []).append(g)
        by_first: dict[str, list[str]] = {}
        for g in full:
            by_first.setdefault(g[0], []).append(g)
        fitting: dict[str, set[str]] = {}

        def fits_of(g: str) -> set[str]:
            """The profiles an initial or a cut form may stand for."""
            stem = g.rstrip(".")
            if g.endswith("."):
                return {root.get(x, x) for x in by_first.get(stem[0], ()) if x.startswith(stem[:2]) and (x.startswith(stem) or within_one(x[: len(stem)], stem))}
            return set(letters.get(stem[0], ())) if len(stem) == 1 else {x for x in weight if within_one(x[: len(stem)], stem)}

        def fit(given, nick: str, quoted) -> str:
            if not len(given):
                return ""
            g = given[0]
            if len(g) > 2 and not g.endswith("."):
                return root.get(g, g)
            stem = g.rstrip(".")
            if g not in fitting:
                fitting[g] = fits_of(g)
            fits = fitting[g]
            if nick:
                fits = fits & set(quoted) or fits
            rest = [m[0] for m in given[1:]]
            if rest and len(fits) > 1:
                agree = {x for x in fits if middles.get(x) and rest[0] in middles[x]} or {x for x in fits if not middles.get(x)}
                fits = agree or fits
            if len(fits) == 1:
                return next(iter(fits))
            ordered = sorted(fits, key=lambda x: (-weight[x], x))
            if len(ordered) > 1 and weight[ordered[0]] > weight[ordered[1]]:
                return ordered[0]
            # nothing to choose by: those with the same letter stay together, apart from the full names
            return stem[0] if not fits else "?" + stem

        return [fit(g, k, q) for g, k, _, _, _, q in members]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by surname; a surname's names are resolved when the next one begins."""
        at, held = None, []

        def done() -> list[tuple]:
            return [(name, n, at, p) for (name, n, *_), p in zip(held, resolve([(g, k, n, *more) for _, n, g, k, *more in held]))]

        columns = ["name", "n", "surname", "profile"]
        for df in batches:
            out = []
            for name, n, surname, given, nick, common, *more in zip(*[df[c] for c in ("name", "n", "surname", "given", "nick", "common", "formal", "quoted")]):
                if surname != at:
                    out += done()
                    at, held = surname, []
                held.append((name, n, given, nick, common, *[() if x is None else tuple(x) for x in more]))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(done(), columns=columns)

    return run


def identities(rows: DataFrame, name_col: str) -> DataFrame:
    """(name, person): the distinct names with the key of the person or organisation they mean."""
    names = parsed_names(rows, name_col)
    people = names.where("not grp")
    # counts of given names tell slips from names; short forms are known or learned from names that quote one. Both come
    # to the names by joins, however many there are
    first = F.when((F.size("given") > 0) & (F.length(F.col("given")[0]) > 2), F.col("given")[0])
    people = people.select("name", "n", "surname", "given", "nick", first.alias("first"))
    counts = people.where("first is not null").groupBy(F.col("first").alias("g")).agg(F.sum("n").alias("c")).where("c > 1")
    known = rows.sparkSession.createDataFrame(list(NICKNAMES.items()), "short string, full string")
    quoted = people.where("nick <> '' and first is not null").select(F.col("nick").alias("short"), F.col("first").alias("full"))
    shorts = stage(known.unionByName(quoted).groupBy("short").agg(F.collect_set("full").alias("forms")))
    mine, theirs = shorts.select(F.col("short").alias("k1"), F.col("forms").alias("formal")), shorts.select(F.col("short").alias("k2"), F.col("forms").alias("quoted"))
    people = people.join(counts, F.col("first") == F.col("g"), "left").join(mine, F.col("first") == F.col("k1"), "left").join(theirs, F.col("nick") == F.col("k2"), "left")
    people = people.select("name", "n", "surname", "given", "nick", F.coalesce("c", F.lit(0)).alias("common"), "formal", "quoted")
    sorted_ = people.repartition(_tasks(people), "surname").sortWithinPartitions("surname")
    resolved = sorted_.mapInPandas(_profiles(), "name string, n long, surname string, profile string")
    groups = names.where("grp").select("name", "n", "surname", F.lit("").alias("profile"))
    resolved = stage(resolved.unionByName(groups))
    persons = resolved.groupBy("surname", "profile").agg(F.sum("n").alias("n"))
    size = persons.groupBy("surname").agg(F.sum("n").alias("s"))
    persons = stage(persons.join(size, "surname"))
    near = stage(trie_join(size, "surname"))
    both = near.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y")))
    p = persons.select(F.col("surname").alias("x"), F.col("profile").alias("px"), F.col("n").alias("nx"), F.col("s").alias("sx"))
    q = persons.select(F.col("surname").alias("y"), F.col("profile").alias("py"), F.col("n").alias("ny"), F.col("s").alias("sy"))
    fits = (F.col("px") == F.col("py")) | ((F.length("px") == 1) & (F.length("py") > 1) & F.startswith("py", F.col("px")))
    slip = (F.col("sx") <= F.greatest(F.lit(2), F.col("sy") / 50)) & ((F.col("sx") < F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("x") > F.col("y"))))
    joined = both.join(p, "x").join(q, "y").where(fits & slip)
    best = F.max(F.struct((F.col("px") == F.col("py")).alias("same"), "ny", "sy", "y", "py"))
    links = joined.groupBy("x", "px").agg(best.alias("to"), F.count_distinct("py").alias("choices")).where("to.same or choices = 1")
    links = links.select(F.col("x").alias("surname"), F.col("px").alias("profile"), F.col("to.y").alias("ts"), F.col("to.py").alias("tp"))
    # slips of slips come to one person, however long their chain
    key = lambda surname, profile: F.concat_ws("|", surname, profile)
    roots = components(links.select(key("surname", "profile").alias("a"), key("ts", "tp").alias("b")))
    out = resolved.select("name", key("surname", "profile").alias("own")).join(roots, F.col("own") == F.col("node"), "left")
    return out.select("name", F.coalesce("root", "own").alias("person"))


def same_name_pairs(rows: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows with different names of one person or organisation."""
    found = stage(identities(rows, name_col))
    keyed = stage(rows.where(F.col(name_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(name_col).alias("name")).join(found, "name"))
    several = keyed.groupBy("person").agg(F.count_distinct("name").alias("k")).where("k > 1").select("person")
    keyed = keyed.join(several, "person", "left_semi")
    a = keyed.select(F.col("i").alias("a"), F.col("name").alias("na"), "person")
    b = keyed.select(F.col("i").alias("b"), F.col("name").alias("nb"), "person")
    return a.join(b, "person").where("a < b and na <> nb").select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))
