"""Greedy entity resolution in arrival order, inside blocks that cannot affect each other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import components

AUTHOR_THRESHOLD, TITLE_THRESHOLD = 92.0, 94.0


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one integer per row of bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        m = masks.get(c, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); 100 for two empty texts."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    tries = [indel_ratio(left, right)]
    if both:
        tries += [indel_ratio(both, left), indel_ratio(both, right)]
    return max(tries)


def names_agree(a: str, b: str, threshold: float = AUTHOR_THRESHOLD) -> float:
    """The weighted ratio of two folded names if it can reach the threshold, else 0. Names whose lengths differ by half
    or more cannot reach it."""
    if not a or not b or max(len(a), len(b)) >= 1.5 * min(len(a), len(b)):
        return 0.0
    score = max(indel_ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    return score if score >= threshold else 0.0


def resolve_authors(rows: DataFrame, block: str, name: str, order: str, threshold: float = AUTHOR_THRESHOLD) -> DataFrame:
    """(block, name, author_name): each distinct folded name with the canonical name of its author. In order of first
    arrival a name joins the best canonical name of its block at or above the threshold (the first one on a tie) or
    becomes one. Rows are reduced to distinct names with their first arrival before the blocks meet in one task."""
    firsts = rows.where(F.col(name).isNotNull()).groupBy(F.col(block).alias("block"), F.col(name).alias("name")).agg(F.min(order).alias("seq"))

    def greedy(df: pd.DataFrame) -> pd.DataFrame:
        canon: list[str] = []
        out = []
        for n in df.sort_values(["seq", "name"], kind="stable")["name"]:
            scores = [(names_agree(n, c, threshold), -i) for i, c in enumerate(canon)]
            best = max(scores, default=(0.0, 0))
            if best[0] > 0:
                out.append((df["block"].iloc[0], n, canon[-best[1]]))
            else:
                canon.append(n)
                out.append((df["block"].iloc[0], n, n))
        return pd.DataFrame(out, columns=["block", "name", "author_name"])

    return firsts.groupBy("block").applyInPandas(greedy, "block string, name string, author_name string")


def book_components(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, component): rows linked by an equal non-null value of any key, by smallest labels with pointer jumping.
    The graph has one edge from each row to each of its key values, so a frequent value adds no pairs."""
    sides = [rows.where(F.col(k).isNotNull()).select(F.concat(F.lit("r"), F.col(id_col).cast("string")).alias("x"), F.concat(F.lit(f"k{i}:"), F.col(k).cast("string")).alias("y")) for i, k in enumerate(keys)]
    links = sides[0]
    for s in sides[1:]:
        links = links.unionByName(s)
    labels = components(links, "x", "y")
    return rows.select(F.col(id_col).alias("id")).join(labels, F.concat(F.lit("r"), F.col("id").cast("string")) == F.col("node"), "left").select("id", F.coalesce("root", F.concat(F.lit("r"), F.col("id").cast("string"))).alias("component"))


class TitleIndex:
    """The titles of one block with an exact search for those of an indel ratio of at least the threshold.

    Titles of lengths a and b that reach ratio r differ by at most d = (1 - r / 100) * (a + b) insertions and deletions,
    each of which breaks at most three trigrams of the padded title. Of the title's rarest 3 * d + 1 trigrams one is
    therefore in every title searched for, so only the lists of those are read."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.titles: list[str] = []
        self.books: list[list[int]] = []
        self.sets: list[set[str]] = []
        self.lists: dict[str, list[int]] = {}
        self.known: set[tuple[str, int]] = set()
        self.of_title: dict[str, int] = {}

    @staticmethod
    def grams(title: str) -> list[str]:
        padded = f"\u0002\u0002{title}\u0003\u0003"
        return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))

    def add(self, title: str, book: int) -> None:
        if (title, book) in self.known:
            return
        self.known.add((title, book))
        if title in self.of_title:
            self.books[self.of_title[title]].append(book)
            return
        n = self.of_title[title] = len(self.titles)
        self.titles.append(title)
        self.books.append([book])
        grams = self.grams(title)
        self.sets.append(set(grams))
        for g in grams:
            self.lists.setdefault(g, []).append(n)

    def near(self, title: str) -> list[int]:
        """The books of close titles, in order of arrival."""
        r, n = self.threshold / 100, len(title)
        longest = n * (2 - r) / r if r else float("inf")
        budget = int((1 - r) * (n + longest) + 1e-9)
        grams = self.grams(title)
        rarest = sorted(grams, key=lambda g: (len(self.lists.get(g, ())), g))[: 3 * budget + 1]
        own, close = set(grams), []
        for k in {k for g in rarest for k in self.lists.get(g, ())}:
            m = len(self.titles[k])
            differ = int((1 - r) * (n + m) + 1e-9)
            if abs(n - m) <= differ and len(own - self.sets[k]) <= 3 * differ and indel_ratio(title, self.titles[k]) >= self.threshold:
                close += self.books[k]
        return sorted(close)


class BookShelf:
    """The books of one component, in arrival order: a report goes to the book of its ISBN, else of its key, else to
    the first book of any author of its block whose title is close enough and whose ISBN does not contradict."""

    def __init__(self, threshold: float = TITLE_THRESHOLD):
        self.threshold = threshold
        self.books: list[dict] = []
        self.by_isbn: dict[str, int] = {}
        self.by_key: dict[str, int] = {}
        self.by_block: dict[str, TitleIndex] = {}

    def place(self, title: str, isbn: str | None, key: str, block: str | None, blocks: list[str]) -> int:
        at = self.by_isbn.get(isbn) if isbn else None
        if at is None:
            at = self.by_key.get(key)
        if at is None and block:
            near = self.by_block[block].near(title) if block in self.by_block else []
            at = next((i for i in near if not (isbn and self.books[i]["isbn"] and self.books[i]["isbn"] != isbn)), None)
        if at is None:
            at = len(self.books)
            self.books.append({"title": title, "isbn": isbn})
            self.by_key.setdefault(key, at)
        book = self.books[at]
        if isbn and not book["isbn"]:
            book["isbn"] = isbn
            self.by_key.setdefault(f"isbn:{isbn}", at)
        if book["isbn"]:
            self.by_isbn.setdefault(book["isbn"], at)
        for b in blocks:
            self.by_block.setdefault(b, TitleIndex(self.threshold)).add(book["title"], at)
        return at


def resolve_books(books: DataFrame, id_col: str, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """(id, book): books has title, isbn13, dedupe_key, authors (structs with dedupe_key) and arrives in order of
    id_col. Components over ISBN, key and author blocks are independent, so each is resolved in arrival order, as a stream
    of many small ones or one large one to a task."""
    from quillon.functions.text import normalize_title
    from quillon.session import stage

    slim = books.select(F.col(id_col).alias("id"), normalize_title(F.col("title")).alias("title"), "isbn13", "dedupe_key", F.transform("authors", lambda a: a["dedupe_key"]).alias("blocks"))
    slim = stage(slim)
    isbn = slim.select("id", "isbn13", "dedupe_key", F.lit(None).cast("string").alias("block"))
    block = slim.select("id", F.lit(None).cast("string").alias("isbn13"), F.lit(None).cast("string").alias("dedupe_key"), F.explode("blocks").alias("block"))
    parts = book_components(isbn.unionByName(block), "id", ["isbn13", "dedupe_key", "block"]).distinct()

    def shelve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shelf, firsts, of = BookShelf(threshold), [], None
        for df in batches:
            out = []
            for i, title, isbn13, key, blocks, component in df[["id", "title", "isbn13", "dedupe_key", "blocks", "component"]].itertuples(index=False):
                if component != of:  # components come one after the other, and only the shelf of one is kept
                    shelf, firsts, of = BookShelf(threshold), [], component
                own = [b for b in (blocks if blocks is not None else []) if b]
                at = shelf.place(title, isbn13, key, own[0] if own else None, own)
                if at == len(firsts):
                    firsts.append(i)
                out.append((i, firsts[at]))
            yield pd.DataFrame(out, columns=["id", "book"])

    kind = books.schema[id_col].dataType.simpleString()
    arriving = slim.join(parts, "id").repartition("component").sortWithinPartitions("component", "id")
    return arriving.mapInPandas(shelve, f"id {kind}, book {kind}")
