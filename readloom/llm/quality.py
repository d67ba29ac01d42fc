"""Supervised subword embeddings: a text is the mean of learned vectors of its hashed words and character n-grams.

Model: h = mean of E[bucket] over all occurrences of words and of the n-grams in words, logits = h W + b, softmax over two classes, trained
by plain stochastic gradient descent in numpy. The training rows are a bounded sample of the labelled rows (``per_class``
rows of each class, drawn by a hash of the id; together at most ``max_chars`` characters, whole texts only); they come to
the driver. Scores cover every row. As the output layer is linear, the difference of the two logits is a mean of one
number per bucket, so executors get one vector of 2^18 floats and look up words, not embeddings.

Words are runs without white space. One that repeats the word before it is read as the token AGAIN, which has a vector and n-grams like any
other: otherwise a text of one word over and over would be that of this word.

Defined cases: null and empty texts score by the bias alone; a null id is never learnt from and counts as not held
out; repeated label rows vote, a tie counting as 1; labels other than 0 and 1, or null, are ignored; without rows of
both classes each score is the smoothed share of label 1; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import portions, release_memory, releasing, text_or_empty

BITS = 18
GRAMS = (3, 4, 5)
CACHE = 200_000
AGAIN = " again "  # no word has a blank


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat buckets of the words' features, and where each word's begin: the word itself, then its n-grams in <word>."""
    own = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - BITS) for w in words), np.int64, len(words))
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.cumsum(lens) - lens
    left = np.repeat(begins + lens, lens) - np.arange(len(points))  # code points to the end of the word
    word, buckets = [np.arange(len(words))], [own]
    of = np.repeat(np.arange(len(words)), lens)
    for n in GRAMS:
        at = np.nonzero(left >= n)[0]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ points[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        word.append(of[at])
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    word = np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(word[order], np.arange(len(words)))


def train(texts: list[str], labels: list[int], dim: int = 16, steps: int = 30_000, rate: float = 0.6, seed: int = 1):
    """(logit of class 1 less that of class 0 for each bucket, the same of the bias)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for text in texts:
        line = text.split()
        words = Counter(line[:1] + [AGAIN if w == before else w for before, w in zip(line, line[1:], strict=False)])
        if not words:
            rows.append((np.empty(0, np.int64), np.empty(0, np.float32)))
            continue
        flat, begins = word_buckets(list(words))
        times = np.repeat(np.fromiter(words.values(), np.float32, len(words)), np.diff(np.append(begins, len(flat))))
        ids, inverse = np.unique(flat, return_inverse=True)
        share = np.bincount(inverse, weights=times).astype(np.float32)
        rows.append((ids, share / share.sum()))
    epochs, done = -(-steps // len(rows)), 0
    steps = epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            lr = np.float32(rate * (1 - done / steps))
            h = share @ emb[ids]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # the gradient of the cross entropy by the logits
            emb[ids] -= lr * np.outer(share, out @ p)
            out -= lr * np.outer(h, p)
            bias -= lr * p * np.float32(0.1)
            done += 1
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts from the numbers per bucket; keeps those of words it has seen, up to CACHE of them."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.sums, self.sizes, self.again = np.empty(0), np.empty(0), self.index[AGAIN]

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > CACHE:
            self.forget()
        known, get = len(self.sums), self.index.__getitem__
        rows = [np.fromiter(map(get, w), np.int64, len(w)) for w in (t.split() for t in texts)]
        if fresh := list(self.index)[known:]:
            for at in range(0, len(fresh), 50_000):
                flat, begins = word_buckets(fresh[at : at + 50_000])
                self.sums = np.append(self.sums, np.add.reduceat(self.table[flat].astype(np.float64), begins))
                self.sizes = np.append(self.sizes, np.diff(np.append(begins, len(flat))))
        return np.array([self.bias + (self._mean(r) if len(r) else 0.0) for r in rows])

    def _mean(self, r: np.ndarray) -> float:
        r[1:][r[1:] == r[:-1]] = self.again
        return self.sums[r].sum() / self.sizes[r].sum()


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> tuple[list, dict[int, int]]:
    """((text, quality) of the sample: not held out, ``per_class`` per class, ``max_chars`` characters in all; number of labels by class)."""
    votes = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("int").alias("quality"))
        .where(~held_out())
        .withColumn("draw", F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 40)))
    )
    n = {r.quality: r["count"] for r in votes.groupBy("quality").count().collect()}
    # About twice the number of each class: some labels have no document. Some 4 * per_class rows of 20 bytes.
    least = [int((1 << 40) * min(1.0, 2 * per_class / n.get(q, 1))) for q in (0, 1)]
    drawn = F.broadcast(votes.where(F.col("draw") < F.when(F.col("quality") == 0, least[0]).otherwise(least[1])))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    by_class = W.partitionBy("quality").orderBy("draw", "text")
    run = W.orderBy("turn", "quality").rowsBetween(W.unboundedPreceding, 0)
    rows = (
        texts.join(drawn, "doc_id")
        .withColumn("turn", F.row_number().over(by_class))
        .where(F.col("turn") <= per_class)
        .withColumn("chars", F.sum(F.char_length("text")).over(run))
        .where(F.col("chars") <= max_chars)
        .select("text", "quality")
        .collect()
    )
    return rows, n


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 20_000_000) -> tuple[np.ndarray, float]:
    """The model, as train() returns it, from the sample of labelled rows of ``docs``."""
    sample, n = training_rows(docs, labels, per_class, max_chars)
    truth = [r.quality for r in sample]
    if len(set(truth)) < 2:
        share = (sum(truth) + 1) / (len(truth) + 2)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    table, bias = train([r.text for r in sample], truth)
    del sample
    release_memory()  # the driver trains, and needs it for what follows
    # The sample is drawn by class; the bias is moved so that scores follow the shares among all labels.
    ones = sum(truth)
    return table, bias + float(np.log(n[1] / n[0]) - np.log(ones / (len(truth) - ones)))


def _scores(scorer: Scorer, texts: pa.Array) -> np.ndarray:
    z = scorer.logits([t or "" for t in texts.to_pylist()]) if len(texts) else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def quality_scores(
    docs: DataFrame, labels: DataFrame, cut: float = 0.3, per_class: int = 2500, max_chars: int = 20_000_000
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class, max_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in batches:
            scores = [np.empty(0), *(_scores(scorer, part.column(1)) for part in portions(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(releasing(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, per_class: int = 2500, max_chars: int = 20_000_000) -> DataFrame:
    """The rows of ``docs`` with a score of ``cut`` or more, with all their columns. Each row is judged as it passes, so ids do not matter."""
    model, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class, max_chars)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in batches:
            for part in portions(b):
                yield part.filter(pa.array(_scores(scorer, part.column(at)) >= cut, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
