"""Freely typed values mapped to the entries of a reference list, with the values that mean none of them reported.

The list is a dictionary of spellings (labels, rotations, forms without the designator, known abbreviations, learned names) indexed by
symmetric deletes: every string reachable from a spelling by at most `bound` deletions. A typed value is cleaned,
its own deletes are looked up, and the spellings they lead to, which include every one within the bound, are ranked by
a weighted Damerau-Levenshtein distance (neighbouring keys, doubled letters and swaps cost less) and then by how often
the entry's label occurs in the data as such. The dictionary is sent to the tasks only up to a stated size; the rows
are never shuffled, each batch resolves its distinct values once.

A value without a designator ("Falcon Archway") means the entry of that stem unless the data write the stem more often
with another designator, which then is another organisation.

Names that share no letters with an entry ("whodunits" for a kind of mystery) do not follow from edit distance. They are
learned from rows that describe one thing, see `learned_names`, and looked up like the spellings of the list.

Defined cases: null, empty and blank values, stand-ins and everything beyond the bound give -1;
equal distances go to the more frequent entry, then to the smaller id; a value much longer than any spelling is -1;
an empty list maps all to -1.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import fresh, stage

#: Words that say what kind of house a publisher is, and their usual abbreviations.
DESIGNATORS = {
    "press": ["pr"], "university press": ["univ pr", "univ press", "university pr", "up"], "publishing": ["publ", "pubg"], "publishers": ["pubs", "publs"], "house": ["hse"], "books": ["bks"],
    "verlag": ["vlg", "verl"], "editions": ["edns", "eds", "edn"], "media group": ["media grp", "mg"],
}
_LEGAL = r"(?:l\.?t\.?d|l\.?l\.?c|inc|gmbh|s\.?a|ag|plc|corp|& co|and co|\(uk\) limited|\(us\) limited|limited|co)\.?"
_KEYS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
_NEAR = {(a, b) for row in _KEYS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]} | {(a, b) for r, s in zip(_KEYS, _KEYS[1:]) for i, a in enumerate(r) for b in s[max(0, i - 1) : i + 1]}
_NEAR |= {(b, a) for a, b in _NEAR}


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case without accents and odd white space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain.lower().replace("ß", "ss").replace("ł", "l").replace("ø", "o")).strip()


def compact(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", text)


def expand(text: str) -> str:
    """Abbreviated designators written out; text is folded."""
    t = " " + re.sub(r"[^a-z0-9&]+", " ", text).strip() + " "
    for full, shorts in DESIGNATORS.items():
        for s in shorts:
            if len(s) > 2 or s == "pr":
                t = t.replace(f" {s} ", f" {full} ")
    return t.strip()


def deletes(text: str, bound: int) -> set[str]:
    found, last = {text}, {text}
    for _ in range(bound):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return found


def bound_for(n: int, most: int) -> int:
    return min(most, 0 if n < 3 else 1 if n < 9 else 2)


def distance(a: str, b: str, limit: float) -> float:
    """Weighted Damerau-Levenshtein distance (swaps of neighbours); beyond limit it may stop early at limit + 1."""
    if a == b:
        return 0.0
    # what both begin and end with costs nothing; one equal letter stays at either end, to tell a doubled one
    most = min(len(a), len(b))
    k = 0
    while k < most and a[-1 - k] == b[-1 - k]:
        k += 1
    k = max(0, k - 1)
    a, b = a[: len(a) - k], b[: len(b) - k]
    most, k = min(len(a), len(b)), 0
    while k < most and a[k] == b[k]:
        k += 1
    k = max(0, k - 1)
    a, b = a[k:], b[k:]
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [float(i)]
        for j, y in enumerate(b, 1):
            drop = 0.7 if i > 1 and a[i - 2] == x else 1.0
            add = 0.7 if j > 1 and b[j - 2] == y else 1.0
            change = 0.0 if x == y else 0.8 if (x, y) in _NEAR else 1.0
            best = min(before[j] + drop, row[j - 1] + add, before[j - 1] + change)
            if x != y and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, older[j - 2] + 0.8)
            row.append(best)
        if min(row) > limit:
            return limit + 1
    return row[-1]


class Dictionary:
    """The spellings of one field's entries."""

    def __init__(self, entries: list[tuple[int, str, str | None]], thesaurus: dict[str, list[str]] | None = None, most: int = 2, designated: bool = False):
        self.most, self.designated = most, designated
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.short: dict[str, int] = {}
        self.stems: dict[str, set[int]] = defaultdict(set)
        self.designator: dict[int, str] = {}
        for ref, label, short in entries:
            words = expand(fold(label)).split()
            for k in range(len(words)):
                self.exact["".join(words[k:] + words[:k])].add(ref)
            if short:
                self.short[compact(fold(short))] = ref
            if designated and (cut := self._split(words)):
                self.stems["".join(cut[0])].add(ref)
                self.designator[ref] = cut[1]
            for phrase in (thesaurus or {}).get(label, []):
                self.exact[compact(fold(phrase))].add(ref)
        self.frequency: dict[int, int] = {}
        self.blocked: set[str] = set()
        self._index()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("deleted", "spellings")}

    def __setstate__(self, state: dict) -> None:
        """Only the spellings travel to the tasks; each worker builds the index of deletes once."""
        self.__dict__.update(state)
        self._index()

    @staticmethod
    def _split(words: list[str]) -> tuple[list[str], str] | None:
        for d in sorted(DESIGNATORS, key=len, reverse=True):
            k = len(d.split())
            if len(words) > k:
                if words[-k:] == d.split():
                    return words[:-k], d
                if words[:k] == d.split():
                    return words[k:], d
        return None

    def _index(self) -> None:
        self.spellings = dict(self.exact)
        for stem, refs in self.stems.items():
            if len(refs) == 1 and stem not in self.blocked:
                self.spellings.setdefault(stem, refs)
        self.deleted: dict[str, list[str]] = defaultdict(list)
        for w in self.spellings:
            for d in deletes(w, bound_for(len(w), self.most)):
                self.deleted[d].append(w)
        self.longest = max(map(len, self.spellings), default=0) + self.most

    def weigh(self, counts: dict[str, int]) -> None:
        """counts: how often each folded, expanded, compact value occurs. Sets the entries' frequencies, and blocks the
        stems that the data write more often with a designator that no entry of the stem has."""
        for w, refs in self.exact.items():
            for r in refs:
                self.frequency[r] = self.frequency.get(r, 0) + counts.get(w, 0)
        for stem, refs in self.stems.items():
            mine = sum(self.frequency.get(r, 0) for r in refs)
            own = {self.designator[r] for r in refs}
            other = max((counts.get(stem + compact(d), 0) + counts.get(compact(d) + stem, 0) for d in DESIGNATORS if d not in own), default=0)
            if other > mine:
                self.blocked.add(stem)
        self._index()

    def add(self, names: list[tuple[str, int]]) -> None:
        """Other names of entries; names that mean one already stay as they are."""
        for form, ref in names:
            self.exact.setdefault(form, {ref})
        self._index()

    def watched(self) -> list[str]:
        """The compact values whose counts weigh() looks at; their number is a multiple of the list's size."""
        return sorted({*self.exact, *(s + compact(d) for s in self.stems for d in DESIGNATORS), *(compact(d) + s for s in self.stems for d in DESIGNATORS)})

    def forms(self, text: str) -> Iterator[str]:
        """The readings of a typed value, the plainest first, as compact strings."""
        t = fold(text)
        seen = set()
        for x in self._undecorated(t):
            c = compact(expand(x))
            if c and c not in seen:
                seen.add(c)
                yield c

    def _undecorated(self, t: str) -> Iterator[str]:
        t = t.replace("_", " ").strip(" *\"'.")
        if not self.designated:
            yield t
            last = re.split(r" ?(?:>|::|»|→|\|) ?| / ", t)[-1].lstrip("# ")
            last = re.sub(r"\s*(?:\([^)]*\)|--.*|& more|and more)$", "", last)
            yield last
            return
        t = re.sub(r"^(?:imprint|publisher|verlag|published by|pub\. by|©|\(c\))(?::| |$)\s*(?=\S)", "", t) if not t.startswith("verlag ") else t
        t = t.lstrip("© ")
        if m := re.fullmatch(r"the (.+?) co\.?", t):
            yield m[1]
        if " : " in t:
            t = t.split(" : ")[-1]
        plain = re.sub(rf"[, ]+{_LEGAL}$", "", t)
        yield plain
        if "," in plain:
            head, tail = (x.strip() for x in plain.rsplit(",", 1))
            yield f"{tail} {head}"  # "Hill House, Elderberry"
            yield head  # a place after the name
        yield re.sub(r"^the ", "", plain)

    def resolve(self, text: str | None) -> int:
        """The id of the entry meant, -1 if none."""
        if not text:
            return -1
        letters = compact(fold(text))
        if letters in self.short and len(text.split()) == 1:
            return self.short[letters]
        best: tuple[float, int, int] | None = None
        for k, form in enumerate(self.forms(text)):
            if form in self.spellings:
                return min(self.spellings[form], key=lambda r: (-self.frequency.get(r, 0), r))
            if len(form) > self.longest:
                continue
            bound = bound_for(len(form), self.most)
            for w in {w for d in deletes(form, bound) for w in self.deleted.get(d, ())}:
                limit = min(bound, bound_for(len(w), self.most))
                if (n := distance(form, w, limit)) <= limit:
                    ref = min(self.spellings[w], key=lambda r: (-self.frequency.get(r, 0), r))
                    best = min(best or (9.0, 0, 0), (n, -self.frequency.get(ref, 0), ref))
        return best[2] if best else -1


def compact_column(x: Column) -> Column:
    """The compact form of a plainly typed value in the JVM, for counting; accents of Latin letters are folded."""
    t = F.translate(F.lower(x), "àáâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def _dictionaries(values: DataFrame, field_col: str, value_col: str, entries: DataFrame, thesaurus: dict | None, designated: tuple[str, ...], most: int, max_entries: int) -> dict[str, Dictionary]:
    rows = entries.select("ref_id", "field_name", "label", "short_form").where("label is not null").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"the reference list has more than {max_entries} entries")
    dictionaries: dict[str, Dictionary] = {}
    for name in sorted({r["field_name"] for r in rows}):
        own = [(r["ref_id"], r["label"], r["short_form"]) for r in sorted(rows, key=lambda r: r["ref_id"]) if r["field_name"] == name]
        dictionaries[name] = Dictionary(own, (thesaurus or {}).get(name), most, name in designated)
    watched = [(name, w) for name, d in dictionaries.items() for w in d.watched()]
    if watched:
        frame = values.sparkSession.createDataFrame(pd.DataFrame(watched, columns=["wf", "w"]), "wf string, w string")
        typed = values.where(F.col(value_col).isNotNull()).select(F.col(field_col).alias("f"), compact_column(F.col(value_col)).alias("c"))
        counted = typed.join(F.broadcast(frame), (F.col("f") == F.col("wf")) & (F.col("c") == F.col("w"))).groupBy("f", "c").count()
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for r in counted.collect():  # at most the watched values
            counts[r["f"]][r["c"]] = r["count"]
        for name, d in dictionaries.items():
            d.weigh(counts[name])
    return dictionaries


def _resolver(spark, dictionaries: dict[str, Dictionary]):
    """A column function (field, text) -> ref_id; each worker resolves a distinct value once."""
    shared = spark.sparkContext.broadcast(dictionaries)
    token = uuid.uuid4().hex

    @F.pandas_udf("long")
    def resolve(fields: pd.Series, texts: pd.Series) -> pd.Series:
        kept = _kept(token)
        pairs = pd.Series(list(zip(fields, texts)))
        known = {}
        for p in pairs.unique():
            if p not in kept:
                d = shared.value.get(p[0])
                kept[p] = d.resolve(p[1]) if d else -1
            known[p] = kept[p]
        if len(kept) > 1_000_000:
            kept.clear()
        return pairs.map(known).astype("int64") if len(pairs) else pd.Series([], dtype="int64")

    return resolve


def plain_form(text: Column) -> Column:
    """The last plain reading of a typed value without its decorations, compact; null if nothing is left."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        reader = Dictionary([])
        known = {t: (list(reader.forms(t)) or [None])[-1] if t else None for t in texts.unique()}
        return texts.map(known)

    return read(text)


def learned_names(resolved: DataFrame, field: str, row: str, key: str, ref: str, form: str, fields: tuple[str, ...], support: int = 3, exclusive: float = 0.6, rarest: float = 1 / 20_000) -> DataFrame:
    """(field, form, ref, rows, share): other names of entries, learned from rows that describe one thing (equal `key`).

    A value that means no entry so far, in a row whose partners have entries that the row itself lacks, votes for each
    of those. A form stands for the entry that gets most of its votes if that has at least `support` rows, and at least
    the share `exclusive` of the form's rows that could vote. Forms with less than the share `rarest` of all votes are
    left out, so there are at most 1 / rarest names, whatever the size of the data."""
    rows = resolved.where(F.col(field).isin(list(fields)) & F.col(key).isNotNull()).select(F.col(field).alias("f"), F.col(row).alias("r"), F.col(key).alias("k"), F.col(ref).alias("e"), F.col(form).alias("w"))
    known = rows.where("e >= 0")
    group = known.groupBy("f", "k").agg(F.collect_set("e").alias("theirs"))  # at most the reference list
    own = known.groupBy(F.col("f").alias("f2"), F.col("r").alias("r2")).agg(F.collect_set("e").alias("mine"))
    open_ = rows.where("e < 0 and w is not null").select("f", "r", "k", "w").distinct()
    votes = open_.join(group, ["f", "k"]).join(own, (F.col("f") == F.col("f2")) & (F.col("r") == F.col("r2")), "left")
    votes = votes.select("f", "w", F.array_except("theirs", F.coalesce("mine", F.array().cast("array<bigint>"))).alias("lacking")).where("size(lacking) > 0")
    votes = stage(votes)
    least = F.greatest(F.lit(support), F.ceil(F.lit(votes.count() * rarest)))
    counted = votes.select("f", "w", F.explode("lacking").alias("e")).groupBy("f", "w", "e").agg(F.count("*").alias("n"))
    best = counted.groupBy("f", "w").agg(F.max(F.struct("n", (-F.col("e")).alias("low"))).alias("b"))
    total = votes.groupBy(F.col("f").alias("f3"), F.col("w").alias("w3")).agg(F.count("*").alias("total"))
    joined = best.join(total, (F.col("f") == F.col("f3")) & (F.col("w") == F.col("w3")))
    out = joined.select(F.col("f").alias("field"), F.col("w").alias("form"), (-F.col("b.low")).alias("ref"), F.col("b.n").alias("rows"), (F.col("b.n") / F.col("total")).alias("share"))
    return out.where((F.col("rows") >= least) & (F.col("share") >= exclusive))


def mapped(values: DataFrame, field_col: str, value_col: str, entries: DataFrame, thesaurus: dict[str, dict[str, list[str]]] | None = None, designated: tuple[str, ...] = ("publisher",), most: int = 2, max_entries: int = 2_000, out: str = "ref_id", learn: tuple[str, str] | None = None, learned_fields: tuple[str, ...] = ("category",)) -> DataFrame:
    """values with `out`. entries has (ref_id, field_name, label, short_form) and at most max_entries rows, which is
    checked: that bounds what the tasks receive. learn names the columns of a row's id and of a key that rows about one
    thing share; other names of the entries of learned_fields are then learned from the data."""
    spark = values.sparkSession
    dictionaries = _dictionaries(values, field_col, value_col, entries, thesaurus, designated, most, max_entries)
    field, value = F.col(field_col), F.col(value_col)
    if learn is None:
        return values.withColumn(out, _resolver(spark, dictionaries)(field, value))
    first, form = fresh(values, "_first"), fresh(values, "_form")
    resolved = values.withColumn(first, _resolver(spark, dictionaries)(field, value))
    resolved = stage(resolved.withColumn(form, F.when((F.col(first) < 0) & field.isin(list(learned_fields)), plain_form(value))))
    names = learned_names(resolved, field_col, *learn, first, form, learned_fields).collect()  # bounded by rarest
    for name, d in dictionaries.items():
        d.add(sorted((r["form"], r["ref"]) for r in names if r["field"] == name))
    again = F.when(F.col(first) >= 0, F.col(first)).otherwise(_resolver(spark, dictionaries)(field, F.when(F.col(first) < 0, value)))
    return resolved.withColumn(out, again).drop(first, form)


_WORKER: dict[str, dict] = {}


def _kept(token: str) -> dict:
    """What this Python worker has resolved so far with one set of dictionaries; those used last stay."""
    kept = _WORKER.pop(token, {})
    _WORKER[token] = kept
    while len(_WORKER) > 4:
        _WORKER.pop(next(iter(_WORKER)))
    return kept
