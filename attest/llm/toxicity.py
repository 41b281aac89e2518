"""Toxicity of whole texts: a factorization machine over hashed terms.

Terms are runs of letters, lower-cased, hashed into BUCKETS buckets; a text is the set of its buckets.
The score is the logistic function of

    bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

over the buckets of the text, with RANK numbers in each v. The pairs say what no sum of single weights
can: that an insult counts with the mention of a group, and neither does alone. All pairs cost no more
than the buckets: they sum to half of |sum of v|^2 - sum of |v|^2.

Learning. Of the labelled rows each label gives at most ROWS, those of least hash of id and text, and
these give at most FEATURES buckets in all; buckets of fewer than LEAST of them are left out. So what
the driver holds is bounded, whatever the corpus. The weights are fitted by Adagrad on batches in a
fixed order, with log loss and shrinkage of w and v. The two labels may be sampled at different rates;
the bias is put right for that, so the score is a probability in the table that the labels came from.
The model goes to the tasks once: at most BUCKETS x (1 + RANK) numbers.

Documents are read once for learning (their labels come in by a join on doc_id) and once for scoring;
texts are taken whole, in steps of bounded size.

Defined results: a null text is empty; an empty text has the score of the bias. Without labels of both
kinds the score is the share of label 1 among those there are, 0 where there are none. A doc_id with
several labels is 1 if one of them is; null labels and ids teach nothing. Repeated rows count each; rows
come out as often as they come in. Other columns don't matter; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import steps, written
from ._text import codes, letters, mixed, numbers

BITS = 20
BUCKETS = 1 << BITS
RANK = 4
#: Letters of the stems that count beside whole terms: inflected forms share them.
STEMS = (4, 5, 6)
#: Labelled rows that a model is fitted on, of each label; their buckets in all; and rows that a bucket needs.
ROWS, FEATURES, LEAST = 8192, 6_000_000, 5
ROUNDS, BATCH, STEP = 24, 64, 0.7
#: Chi-square of the label and a bucket that is kept. Of what counts only together with something else, each part tells something alone too.
TELLS = 16.0
#: Shrinkage of w and v at each step that meets them.
SHRINK, SHRINK_PAIRS = 5e-4, 5e-4
THRESHOLD = 0.7


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts, each once a text and in order, and where each text's start (with the end)."""
    flat, starts = codes([x.lower() for x in texts])
    black = np.zeros(len(flat) + 2, bool)
    black[1:-1] = letters()[flat]
    edge = np.flatnonzero(black[1:] != black[:-1])
    begin, end = edge[::2], edge[1::2]
    owner = (np.searchsorted(starts, begin, "right") - 1).astype("uint64") << np.uint64(BITS)
    size = end - begin
    found = [owner | numbers(flat, begin, end) >> np.uint64(64 - BITS)]
    for n in STEMS:
        some = np.flatnonzero(size > n)
        found.append(owner[some] | mixed(numbers(flat, begin[some], begin[some] + n) + np.uint64(n)) >> np.uint64(64 - BITS))
    found = np.unique(np.concatenate(found))
    first = np.searchsorted(found, np.arange(len(texts) + 1, dtype="uint64") << np.uint64(BITS))
    return (found & np.uint64(BUCKETS - 1)).astype("int64"), first


class Machine:
    """bias, w and v over the buckets that are known (in order); all others weigh nothing."""

    def __init__(self, known: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
        self.known, self.w, self.v, self.bias = known, w, v, bias

    def logits(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        at = np.minimum(np.searchsorted(self.known, bucket), max(0, len(self.known) - 1))
        is_known = self.known[at] == bucket if len(self.known) else np.zeros(len(bucket), bool)
        owner = np.repeat(np.arange(n), np.diff(first))[is_known]
        at = at[is_known]
        z = self.bias + np.bincount(owner, self.w[at], n)
        for k in range(self.v.shape[1]):
            x = self.v[at, k]
            z += 0.5 * (np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n))
        return z

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(texts)), -30, 30)))


def fit(bucket: np.ndarray, first: np.ndarray, label: np.ndarray, rank: int = RANK) -> Machine:
    """A machine fitted on rows: their buckets, where each row's start (with the end), and labels 0 and 1."""
    known, at, n = np.unique(bucket, return_inverse=True, return_counts=True)
    # Chi-square of the bucket and the label, from the rows that hold it.
    held = np.bincount(at, np.repeat(label, np.diff(first)), len(known))
    share, rows = label.mean(), len(label)
    chi = (held - n * share) ** 2 * rows / np.maximum(n * share * (1 - share) * np.maximum(rows - n, 1), 1e-9)
    keep = (n >= LEAST) & (chi >= TELLS)
    place = np.cumsum(keep) - 1
    use = keep[at]
    owner = np.repeat(np.arange(len(label)), np.diff(first))[use]
    at, known = place[at[use]], known[keep]
    first = np.searchsorted(owner, np.arange(len(label) + 1))
    r = np.random.default_rng(13)
    p = float(np.clip(label.mean(), 1e-6, 1 - 1e-6))
    w, v, bias = np.zeros(len(known)), r.normal(0, 0.03, (len(known), rank)), float(np.log(p / (1 - p)))
    seen_w, seen_v, seen_b = np.full(len(known), 1e-2), np.full((len(known), rank), 1e-2), 1e-2
    for _ in range(ROUNDS):
        for rows in np.array_split(order := r.permutation(len(label)), max(1, len(order) // BATCH)):
            size = first[rows + 1] - first[rows]
            own = np.repeat(np.arange(len(rows)), size)
            start = np.cumsum(size) - size
            x = at[np.arange(len(own)) - np.repeat(start, size) + np.repeat(first[rows], size)]
            sums = np.zeros((len(rows), rank))
            some = np.flatnonzero(size)
            if len(some):
                sums[some] = np.add.reduceat(v[x], start[some], 0)
            z = bias + np.bincount(own, w[x], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(own, (v[x] ** 2).sum(1), len(rows)))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]
            hit, to = np.unique(x, return_inverse=True)
            g = np.bincount(to, error[own], len(hit)) + SHRINK * w[hit] * np.bincount(to)
            pairs = error[own][:, None] * (sums[own] - v[x])
            gv = np.stack([np.bincount(to, pairs[:, k], len(hit)) for k in range(rank)], 1) + SHRINK_PAIRS * v[hit] * np.bincount(to)[:, None] if len(hit) and rank else np.zeros((len(hit), rank))
            seen_w[hit] += g * g
            seen_v[hit] += gv * gv
            seen_b += error.sum() ** 2
            w[hit] -= STEP * g / np.sqrt(seen_w[hit])
            v[hit] -= STEP * gv / np.sqrt(seen_v[hit])
            bias -= 0.1 * STEP * error.sum() / np.sqrt(seen_b)
    return Machine(known, w.astype("float32"), v.astype("float32"), bias)


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def chosen(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[int]]:
    """At most ROWS different labelled texts of each label, by hash: (doc_id, h, label), and how many there are of labels 0 and 1 in all."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    keys = docs.filter("doc_id is not null").select("doc_id", _hash(F.col("text")).alias("h")).join(marked, "doc_id")
    texts = written(keys.groupBy("h").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id")), "toxic-texts")
    n = dict(texts.groupBy("label").count().collect())
    least = [texts.filter(F.col("label") == k).orderBy("h").limit(ROWS) for k in (0, 1)]
    return written(least[0].unionByName(least[1]), "toxic-chosen"), [n.get(0, 0), n.get(1, 0)]


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Rows with doc_id and text, and rows with doc_id and toxic -> a machine."""
    rows, there = chosen(docs, labels)
    none = np.zeros(0, "int64")
    if not all(there):
        share = min(1 - 1e-9, max(1e-9, there[1] / max(1, sum(there))))
        return Machine(none, np.zeros(0), np.zeros((0, RANK)), float(np.log(share / (1 - share))))

    def found(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                bucket, first = features(part["text"].fillna("").tolist())
                own = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield part[["h", "label"]].assign(n=np.diff(first), buckets=own)

    # At most 2 x ROWS keys go to the tasks.
    texts = docs.withColumn("h", _hash(F.col("text"))).join(F.broadcast(rows), ["doc_id", "h"]).select("h", "label", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["h"])
    held = written(texts.mapInPandas(found, "h long, label int, n long, buckets binary"), "toxic-features")
    sizes = sorted((r["h"], r["n"]) for r in held.select("h", "n").collect())
    fits = np.searchsorted(np.cumsum([n for _, n in sizes]), FEATURES, "right")
    used = sorted(held.filter(F.col("h") <= sizes[max(0, min(fits, len(sizes)) - 1)][0]).collect(), key=lambda r: r["h"])
    bucket = np.concatenate([np.frombuffer(r["buckets"], "<i4") for r in used])
    first = np.concatenate([[0], np.cumsum([r["n"] for r in used])])
    label = np.array([r["label"] for r in used], "float64")
    machine = fit(bucket, first, label)
    share = label.mean()
    if 0 < share < 1:
        machine.bias += float(np.log(there[1] / there[0]) - np.log(share / (1 - share)))
    return machine


def held_out(doc_id: Column) -> Column:
    """A third of all documents, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows with doc_id and text -> doc_id, held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def of(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                yield part[["id", "no_id"]].assign(score=sent.value.scores(part["text"].fillna("").tolist()))

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    doc_id = F.when(~F.col("no_id"), F.col("id"))
    return rows.mapInPandas(of, "id long, no_id boolean, score double").select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a machine that learned from the labels of those that are not held out."""
    return scored(docs, learn(docs, labels.filter(~held_out(F.col("doc_id")))))
