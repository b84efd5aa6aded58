"""Reading level of each document by a Rasch-style model of word counts.

Words are the items and documents the persons, on one scale of difficulty whose marks are the levels 1..n. As in Rasch's
model of counts, the occurrences of word w in a document of length n at difficulty t follow a Poisson distribution, with

    log rate = log n + a[w] + b[w] * (t - m) - c[w] * (t - m)^2        (m: the middle of the scale, c[w] >= 0)

a[w] is how easily the word occurs at all, b[w] how its occurrence rises with the difficulty of the text. Hard texts do
not answer easy words "too", as persons do easy questions: their words go out of use, so the curve is the unfolding one,
with the word's own difficulty m + b / 2c where it peaks. c[w] = 0 is the plain increasing form. The difficulties of the
documents have a free distribution over the marks (the located-class form of the Rasch model).

Both sides are estimated alternately over the whole corpus until the penalised likelihood stops rising:

  documents, given words: the posterior of each document's difficulty, from two weighted sums of its words;
  words, given documents: Newton steps for a, b, c of every word from three sums over all documents (occurrences, and
  occurrences times the mean and mean square of the difficulty), which tasks sum first and the shuffle then by word.

Human judgements anchor the scale: a judgement of level k multiplies the posterior by a rater's logistic chance of
saying k at that difficulty. The first words' parameters come from the judged documents alone.

Words are hashed into `buckets` items, so that the parameters have a fixed size (buckets x 3 numbers) however large the
corpus, and they are all that a pass carries to the tasks. Counts cover every document and every word.

Defined cases: null and empty texts have no words and no level; a text in another language than English, without any
function word of a known language, or with fewer than min_words words, has none either; without any judgement there is
no scale and the result is empty; repeated judgements of one document all count; markup is not text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import stage

BUCKETS = 1 << 16
#: Frequent function words that tell the languages apart. English is the one whose words are the most frequent.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as but not are by this from be has have who which i my we you at on an".split(),
    "fr": "le la les des un une et est dans que qui pour pas du au avec sur se ce plus elle il mais par ses aux nous".split(),
    "de": "der die das und ist ein eine einen den von mit zu im nicht auf sich auch doch etwas er sie aus dem wie bei".split(),
    "es": "el la los las un una y es en que con para por del se lo como al su sus pero aunque muy".split(),
    "it": "il lo gli una e di che con per del della non sono nel alla come anche".split(),
    "pt": "o os um uma e em que com para por do da dos das não como mais seu sua".split(),
    "nl": "de het een en van in is dat op te met voor niet zijn ook aan door".split(),
}


def word_items(text: Column, buckets: int = BUCKETS) -> Column:
    """array<int>: the hashed words of a text without its markup, in order."""
    plain = F.regexp_replace(text, r"<[^<>]*>|&[a-zA-Z]{2,8};|&#\d{1,6};", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}+(?:['’\-]\p{L}+)*"), F.lit(0))
    return F.transform(words, lambda w: F.crc32(F.encode(w, "UTF-8")).bitwiseAND(F.lit(buckets - 1)).cast("int"))


def n_words(text: Column) -> Column:
    plain = F.regexp_replace(text, r"<[^<>]*>|&[a-zA-Z]{2,8};|&#\d{1,6};", " ")
    return F.size(F.regexp_extract_all(plain, F.lit(r"[^\s]*[\p{L}\p{N}][^\s]*"), F.lit(0)))


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) & (buckets - 1)


def _language_table(buckets: int) -> np.ndarray:
    out = np.zeros((buckets, len(FUNCTION_WORDS)), np.float32)
    for j, words in enumerate(FUNCTION_WORDS.values()):
        for w in words:
            out[_bucket(w, buckets), j] = 1
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch in one array, and the number of words of each row."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` over consecutive runs of the given sizes."""
    total = np.zeros((len(sizes), values.shape[1]))
    full = sizes > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        total[full] = np.add.reduceat(values, starts, axis=0)
    return total


def english(df: DataFrame, id_col: str, text_col: str, min_words: int = 20, buckets: int = BUCKETS, votes: DataFrame | None = None) -> DataFrame:
    """(id, words): the English documents with enough words, as arrays of items; staged in the shared folder. With votes
    (id, votes) there is a third column, null where nobody judged."""
    table = _language_table(buckets)
    source = df.select(F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("n"), F.coalesce(word_items(F.col(text_col), buckets), F.array().cast("array<int>")).alias("words")).where(F.col("n") >= min_words).select("id", "words")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = _flat(batch.column(1))
            hits = _row_sums(table[words], sizes) if len(words) else np.zeros((batch.num_rows, table.shape[1]))
            mine = (hits[:, 0] > 0) & (hits[:, 0] >= hits.max(axis=1))
            yield batch.filter(pa.array(mine))

    kept = source.mapInArrow(keep, source.schema)
    return stage(kept if votes is None else kept.join(votes, "id", "left").select("id", "words", "votes"))


class RaschCounts:
    """Item parameters (a, b, c per bucket) and the distribution of document difficulties over the levels."""

    def __init__(self, n_levels: int, buckets: int, ridge: float = 0.3, rater_slope: float = 4.0):
        self.levels, self.ridge = n_levels, ridge
        t = np.arange(n_levels) - (n_levels - 1) / 2
        self.design = np.stack([np.ones(n_levels), t, -(t**2)], axis=1)
        self.items = np.zeros((buckets, 3))
        self.used = np.zeros(buckets, bool)
        self.log_prior = np.full(n_levels, -np.log(n_levels))
        self.log_rate = np.zeros(n_levels)  # log of the summed rates at each level, near 0
        # a rater's chance of each level at each difficulty: steps of equal slope half-way between the levels
        steps = 1 / (1 + np.exp(-rater_slope * (np.arange(n_levels)[:, None] - np.arange(1, n_levels)[None, :] + 0.5)))
        above = np.concatenate([np.ones((n_levels, 1)), steps, np.zeros((n_levels, 1))], axis=1)
        self.log_rater = np.log(np.clip(above[:, :-1] - above[:, 1:], 1e-6, None)).T  # [judged level, difficulty]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a pass needs: item parameters (0 for words never seen), log prior, summed rates."""
        return np.where(self.used[:, None], self.items, 0.0).astype(np.float32), self.log_prior, np.exp(self.log_rate)

    def log_odds(self) -> np.ndarray:
        """What one occurrence of each item adds to the log-probability of each level, against the lowest."""
        rates = self.tables()[0] @ self.design.T
        return (rates - rates[:, :1]).astype(np.float32)

    def update(self, sums: np.ndarray, exposure: np.ndarray, mass: np.ndarray, steps: int = 8) -> None:
        """Newton steps for every item. sums: per item the occurrences times each column of the design; exposure: words
        read at each level; mass: documents at each level."""
        x, seen = self.design, sums[:, 0] > 0
        fresh = seen & ~self.used
        self.items[fresh, 0] = np.log(sums[fresh, 0] / exposure.sum())
        self.used |= seen
        at = np.flatnonzero(self.used)
        items, target = self.items[at], sums[at]
        penalty = np.array([0.0, self.ridge, self.ridge])
        squares = np.einsum("gi,gj->gij", x, x).reshape(len(x), -1)
        for _ in range(steps):
            rate = np.exp(np.clip(items @ x.T, -40, 5)) * exposure
            slope = target - rate @ x - items * penalty
            curve = (rate @ squares).reshape(-1, 3, 3) + np.diag(penalty) + 1e-3 * np.eye(3)
            items = items + np.clip(np.linalg.solve(curve, slope[..., None])[..., 0], -1, 1)
            items[:, 2] = np.maximum(items[:, 2], 0)  # a word has one place on the scale
            items[:, 0] = np.maximum(items[:, 0], -25)
        self.items[at] = items
        self.log_rate = np.log(np.exp(np.clip(items @ x.T, -40, 5)).sum(axis=0))
        self.log_prior = np.log((mass + 1) / (mass + 1).sum())


def _evidence(words: np.ndarray, sizes: np.ndarray, tables: tuple, design: np.ndarray) -> np.ndarray:
    """The log joint probability of each document's words and each level."""
    items, log_prior, rates = tables
    return _row_sums(items[words], sizes) @ design.T - sizes[:, None] * rates + log_prior


def _normalised(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = s.max(axis=1, keepdims=True)
    e = np.exp(s - top)
    return e / e.sum(axis=1, keepdims=True), (top + np.log(e.sum(axis=1, keepdims=True)))[:, 0]


def _votes(column: pa.Array, n_levels: int) -> np.ndarray:
    """Judgements of each level per row; rows without any are zero."""
    out = np.zeros((len(column), n_levels))
    for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
        out[i] = column[int(i)].as_py()
    return out


def _pass(docs: DataFrame, model: RaschCounts, buckets: int, judged_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One pass over docs (words, votes): the sums per item, the words and documents at each level, the log-likelihood.
    Each task sums into one table and sends its non-empty rows."""
    n, tables, design, log_rater = model.levels, model.tables(), model.design, model.log_rater

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, marks = np.zeros((buckets, 3)), np.zeros((n, 3))
        for batch in batches:
            words, sizes = _flat(batch.column(0))
            said = _votes(batch.column(1), n) @ log_rater
            post, likelihood = _normalised(said if judged_only else _evidence(words, sizes, tables, design) + said)
            moments = post @ design
            each = np.repeat(moments, sizes, axis=0)
            for k in range(3):
                sums[:, k] += np.bincount(words, each[:, k], minlength=buckets)
            marks[:, 0] += sizes @ post
            marks[:, 1] += post.sum(axis=0)
            marks[0, 2] += likelihood.sum()
        used = np.flatnonzero(sums[:, 0])
        item = np.concatenate([used, -1 - np.arange(n)]).astype("int32")
        rows = np.concatenate([sums[used], marks])
        yield pa.RecordBatch.from_arrays([pa.array(item), *[pa.array(rows[:, k]) for k in range(3)]], names=["item", "s0", "s1", "s2"])

    rows = docs.where("votes is not null") if judged_only else docs
    parts = rows.select("words", "votes").mapInArrow(partial, "item int, s0 double, s1 double, s2 double")
    # at most buckets + n_levels rows, a bound that does not depend on the corpus
    total = parts.groupBy("item").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)]).toPandas()
    sums, marks = np.zeros((buckets, 3)), np.zeros((n, 3))
    item, values = total["item"].to_numpy().astype(int), total[["s0", "s1", "s2"]].to_numpy()
    sums[item[item >= 0]] = values[item >= 0]
    marks[-1 - item[item < 0]] = values[item < 0]
    return sums, marks[:, 0], marks[:, 1], float(marks[0, 2])


def _counted_votes(labels: DataFrame, n_levels: int) -> DataFrame:
    """(id, votes) of labels (id, level): how often each level was said."""
    votes = F.array(*[F.sum(F.when(F.col("level") == k + 1, 1.0).otherwise(0.0)) for k in range(n_levels)])
    return labels.where(F.col("level").between(1, n_levels)).groupBy("id").agg(votes.alias("votes"))


def fit(docs: DataFrame, labels: DataFrame | None, n_levels: int = 5, most_rounds: int = 20, tolerance: float = 1e-4, buckets: int = BUCKETS) -> RaschCounts | None:
    """The model of docs (id, words), with judgements labels (id, level) or already with a column votes. None without a
    usable judgement. Rounds alternate until the penalised log-likelihood gains less than `tolerance` of itself."""
    if "votes" not in docs.columns:
        docs = docs.join(_counted_votes(labels, n_levels), "id", "left")
    model = RaschCounts(n_levels, buckets)
    sums, exposure, mass, _ = _pass(docs, model, buckets, judged_only=True)
    if mass.sum() == 0 or exposure.sum() == 0:
        return None
    model.update(sums, exposure, mass)
    last = None
    for k in range(most_rounds):
        sums, exposure, mass, likelihood = _pass(docs, model, buckets, judged_only=False)
        value = likelihood - model.ridge / 2 * float((model.items[:, 1:] ** 2).sum())
        if last is not None and value - last < tolerance * abs(last):
            break
        last = value if k else None  # before the first full round most words have no parameters yet
        model.update(sums, exposure, mass)
    return model


def reading_levels(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, n_levels: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """(id, reading_level, difficulty): the most probable level of every English document with min_words words by its
    words alone, and its expected difficulty. labels has (id, level)."""
    docs = english(df, id_col, text_col, min_words, buckets, _counted_votes(labels, n_levels))
    model = fit(docs, None, n_levels, buckets=buckets)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, reading_level int, difficulty double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    tables, design = model.tables(), model.design

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = _flat(batch.column(1))
            p = _normalised(_evidence(words, sizes, tables, design))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((p.argmax(axis=1) + 1).astype("int32")), pa.array(p @ np.arange(1, n_levels + 1))], names=[id_col, "reading_level", "difficulty"])

    return docs.select("id", "words").mapInArrow(score, schema)


def brute_force_items(text: str, buckets: int = BUCKETS) -> list[int]:
    """The items of one text in plain Python, for tests."""
    plain = re.sub(r"<[^<>]*>|&[a-zA-Z]{2,8};|&#\d{1,6};", " ", text or "").lower()
    return [_bucket(w, buckets) for w in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", html.unescape(plain))]
