"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; all that are not letters count as one space. Runs of 1 to 3 characters
are hashed into BUCKETS buckets. Training counts them by language over every labelled row: a task
adds up its rows into one vector per language, and vectors are added up in levels. Log probabilities,
with additive smoothing, form a matrix of languages x buckets, whose size does not depend on the
data; it goes to the tasks once, in blocks of BLOCK languages. Scoring looks up the matrix at the buckets of many texts at once and
sums by text.

Score: the posterior of the language chosen, with the evidence of a text counted as that of at most
EVIDENCE n-grams; neighbouring n-grams overlap, and uncut products would round to 1.

Defined results: null text, or no letter in it: ``und`` with score 0. Ties go to the language first by
code point. A null label teaches nothing; with no labelled row at all every text is ``und``. Any number of
labels is learned, block by block. Texts are taken whole, in steps of bounded size; repeated rows count
each; an empty table gives an empty result. Other columns pass through, whatever their names, except
those of the names that are added.
"""

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import steps, tree_sum, written
from ._text import codes, letters, mixed

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
EVIDENCE = 64
#: Languages whose counts and probabilities are held at once: 32 MB.
BLOCK = 256
UNKNOWN = "und"
#: Below this a document is rejected as being in no known language.
LEAST_SCORE = 0.5


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, where each text's start (with the end), and which texts have a letter.

    Runs of other characters are one space; a space is put before and after each text.
    """
    flat, starts = codes(["\n" + x.lower() for x in texts])
    letter = letters()[flat]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first stands for all
    keep[starts[:-1]] = True
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    sign = np.where(letter, flat, np.uint32(32))[keep].astype("uint64") + np.uint64(1)
    owner = owner[keep]
    out, whose = [], []
    value = np.zeros(len(sign), "uint64")
    for n in range(1, max(ORDERS) + 1):
        value = value[: len(sign) - n + 1] * np.uint64(0x100000001B3) + sign[n - 1 :]
        if n in ORDERS:
            # A run that spans two texts has the space between them inside: it belongs to neither.
            within = owner[: len(value)] == owner[n - 1 :]
            if n == 1:
                within &= sign != 33
            out.append((mixed(value[within] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype("int64"))
            whose.append(owner[: len(value)][within])
    whose, out = np.concatenate(whose), np.concatenate(out)
    order = np.argsort(whose, kind="stable")
    has = np.zeros(len(texts), bool)
    has[np.unique(owner[sign != 33])] = True
    return out[order], np.searchsorted(whose[order], np.arange(len(texts) + 1)), has


def train(docs: DataFrame, least: float = SMOOTHING) -> list[tuple[list[str], np.ndarray, Broadcast]]:
    """Rows with text and lang -> per block of labels, in order: labels, log priors, and the matrix of log probabilities (float32, buckets x labels), broadcast."""
    def count(batches):
        from pyspark import TaskContext

        def packed(sums):
            return pd.DataFrame({"lang": list(sums), "part": TaskContext.get().partitionId(), "counts": [v.astype("<i8").tobytes() for v in sums.values()]})

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in steps(batch, "text"):
                where, first, _ = grams(rows["text"].tolist())
                label = rows["lang"].to_numpy()
                for x in set(label):
                    own = np.repeat(label == x, np.diff(first))
                    v = sums.setdefault(x, np.zeros(BUCKETS + 1, "int64"))
                    v[:-1] += np.bincount(where[own], minlength=BUCKETS)
                    v[-1] += (label == x).sum()
                    if len(sums) >= BLOCK:
                        yield packed(sums)
                        sums = {}
        if sums:
            yield packed(sums)

    labelled = docs.select("text", "lang").filter("text is not null and lang is not null")
    parts = written(labelled.mapInPandas(count, "lang string, part long, counts binary"), "lang-counts")
    labels = sorted(r["lang"] for r in parts.select("lang").distinct().collect())
    n_docs, found = 0, []
    for k in range(0, len(labels), BLOCK):
        own = labels[k : k + BLOCK]
        rows = {r["lang"]: np.frombuffer(r["counts"], "<i8") for r in tree_sum(parts.filter(F.col("lang").between(own[0], own[-1])), ["lang"], "counts").collect()}
        sums = np.array([rows[x] for x in own], "float64")
        counts = sums[:, :-1]
        n_docs += sums[:, -1].sum()
        log_p = np.log(counts + least) - np.log(counts.sum(1, keepdims=True) + least * BUCKETS)
        found.append((own, sums[:, -1], docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(log_p.T.astype("float32")))))
    return [(own, np.log(n / n_docs), log_p) for own, n, log_p in found]


def scored(texts: list[str], prior: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: index of the best label (-1: none), its log posterior, and of the posteriors with EVIDENCE: the best label's, the largest, and the sum of their powers less the largest."""
    where, first, has = grams(texts)
    best = np.full(len(texts), -1)
    total_, own, most, mass = (np.zeros(len(texts)) for _ in range(4))
    n = np.diff(first)
    use = np.flatnonzero(has & (n > 0))
    if len(use) and log_p.shape[1]:
        total = np.empty((len(use), log_p.shape[1]))
        for k in range(log_p.shape[1]):
            # Texts without n-grams have no part of the sum: reduceat gets the starts of the others only.
            total[:, k] = np.add.reduceat(log_p[:, k].astype("float64")[where], first[:-1][use])
        with_prior = total + prior
        best[use] = with_prior.argmax(1)
        at = np.arange(len(use)), best[use]
        share = np.minimum(1.0, EVIDENCE / n[use])[:, None] * total + prior
        total_[use], own[use], most[use] = with_prior[at], share[at], share.max(1)
        mass[use] = np.exp(share - share.max(1, keepdims=True)).sum(1)
    return best, total_, own, most, mass


def predict(docs: DataFrame, model: list[tuple[list[str], np.ndarray, Broadcast]]) -> DataFrame:
    """Adds lang_pred and score to rows with text."""
    old = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def block(labels: list[str], prior: np.ndarray, log_p: Broadcast):
        names = np.array([*labels, None], object)

        @F.pandas_udf("lang string, total double, own double, most double, mass double")
        def of(text: pd.Series) -> pd.DataFrame:
            found = [scored(rows["text"].fillna("").tolist(), prior, log_p.value) for rows in steps(pd.DataFrame({"text": text}), "text")]
            best, *numbers = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, "int64")] + [np.zeros(0)] * 4
            return pd.DataFrame({"lang": names[best], **dict(zip(("total", "own", "most", "mass"), numbers, strict=True))})

        return of("text")

    docs = docs.select(F.struct(*old).alias("row"), "text")
    if not model:
        return docs.select("row.*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    blocks = [f"b{k}" for k in range(len(model))]
    docs = docs.select("row", *(block(*m).alias(b) for b, m in zip(blocks, model, strict=True)))
    if len(model) == 1:
        lang, own, most, mass = (F.col(f"b0.{c}") for c in ("lang", "own", "most", "mass"))
    else:
        # The first block with the largest posterior has the label; sums of powers are put on one scale.
        order = [F.when(F.col(f"{b}.lang").isNotNull(), F.struct(F.col(f"{b}.total").alias("total"), F.lit(-k).alias("k"), F.col(f"{b}.lang").alias("lang"), F.col(f"{b}.own").alias("own"))) for k, b in enumerate(blocks)]
        top = F.greatest(*order)
        lang, own = top["lang"], top["own"]
        most = F.greatest(*(F.col(f"{b}.most") for b in blocks))
        mass = sum((F.col(f"{b}.mass") * F.exp(F.col(f"{b}.most") - most) for b in blocks), F.lit(0.0))
    score = F.when(lang.isNotNull(), F.least(F.lit(1.0), F.exp(own - most) / mass)).otherwise(0.0)
    return docs.select("row.*", F.coalesce(lang, F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Documents with doc_id, text and lang -> doc_id, held_out, lang_pred, score; learned from those not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that are in a known language, with all their columns."""
    model = train(docs)
    found = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
