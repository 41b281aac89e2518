"""How filters act together: survival words and their positional popcounts.

A document fails some of the filters; its survival word has 32 bits, one for each subset of the five
filters, set if the document passes all filters of the subset. Counting each bit over the documents of a
part, for all of them and for those of a label, gives how many survive each subset; every figure of every
order of filters is a difference of two such counts, so documents are read once, not once an order.

Counting is carry-save: words of equal weight are taken in threes, a sum word (their parity) keeps the
weight and a carry word (their majority) has twice of it, until at most two words of each weight are left
(``positional``). A task adds up its words by part; parts are summed by Spark before anything else.

Whether a text equals that of a smaller doc_id is known from the least doc_id of each text (a sum by hash of
the text, made before rows are shuffled), joined on hash and doc_id: a row that is the least of its text finds
itself there, so a text of which there are very many copies makes no hot key. Labels come in by a join on
doc_id of rows without texts.

Defined results: a null text is empty; a null source is the part of the empty string. A null doc_id has no
order and no labels: it is never identical to a smaller one, nor makes another so. Of several rows with the
least doc_id of a text all pass. A doc_id with several labels has one if any of them says so; null labels
say nothing. An empty table has no parts and gives no rows. Other columns don't matter. Texts are taken whole.
"""

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
FEWEST_WORDS = 200
#: Distinct words of 100, at least; upper-case letters of 100 characters, at most.
DISTINCT, UPPER = 50, 2
#: Parts that a task adds up before it hands them on.
PARTS = 4096

_WORD = r"[^\x20\x09-\x0D]+"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def flags(docs: DataFrame) -> DataFrame:
    """Rows with doc_id, source and text -> doc_id, part, key (a hash of the text), fails (bits of A to D)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failing = {"A": n < FEWEST_WORDS, "B": 100 * different < DISTINCT * n, "C": 100 * upper > UPPER * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}
    fails = sum((F.when(c, _bit(k)).otherwise(0) for k, c in failing.items()), F.lit(0))
    return docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), fails.alias("fails"))


def words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and labels -> part, good, toxic, word (the survival word) of every row."""
    rows = written(flags(docs), "audit-flags")
    known = rows.filter("doc_id is not null")
    least = known.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    known = known.join(least, ["key", "doc_id"], "left").join(marked, "doc_id", "left")
    no = F.lit(False)
    known = known.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (F.col("fails") + F.when(F.col("first").isNull(), _bit("E")).otherwise(0)).alias("fails"))
    rows = known.unionByName(rows.filter("doc_id is null").select("part", no.alias("good"), no.alias("toxic"), "fails"))
    return rows.select("part", "good", "toxic", survival(F.col("fails")).alias("word"))


def survival(fails: Column) -> Column:
    """The survival word of a document that fails these filters."""
    return F.element_at(F.lit([sum(1 << s for s in range(SUBSETS) if not s & x) for x in range(SUBSETS)]), fails.cast("int") + 1)


def positional(found: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set."""
    total, weight, level = np.zeros(SUBSETS, "int64"), 1, found.astype("uint32")
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n :]])
        for x in level:
            total += weight * (x >> np.arange(SUBSETS, dtype="uint32") & np.uint32(1)).astype("int64")
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return total


def survivors(found: DataFrame) -> DataFrame:
    """Survival words -> part, subset, and how many survive it: n, good, toxic."""
    def count(batches):
        def packed(sums):
            return pd.DataFrame({"part": np.repeat(np.array(list(sums), object), SUBSETS), "subset": np.tile(np.arange(SUBSETS), len(sums))} | {k: np.concatenate([x[i] for x in sums.values()]) for i, k in enumerate(("n", "good", "toxic"))})

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, rows in batch.groupby("part", sort=False):
                own = rows["word"].to_numpy()
                new = np.stack([positional(own), *(positional(own[rows[k].to_numpy(bool)]) for k in ("good", "toxic"))])
                sums[part] = sums[part] + new if part in sums else new
                if len(sums) >= PARTS:
                    yield packed(sums)
                    sums = {}
        if sums:
            yield packed(sums)

    parts = found.mapInPandas(count, "part string, subset int, n long, good long, toxic long")
    return parts.groupBy("part", "subset").agg(*(F.sum(k).alias(k) for k in ("n", "good", "toxic")))


def _steps() -> list[tuple[str, int, int, int]]:
    """Every step of every order: the order, the step, the bits of the filters before it, and its filter's."""
    return [("".join(order), k + 1, sum(map(_bit, order[:k])), _bit(name)) for order in permutations(FILTERS) for k, name in enumerate(order)]


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (doc_id, source, text) and labels (doc_id, quality, toxic) -> figures of each part, order and step."""
    counts = survivors(words(docs, labels))
    # A row a part: 32 counts of each kind, by subset.
    counts = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    every = SUBSETS - 1

    def at(kind: str, subset: Column) -> Column:
        return F.element_at(F.col(f"s.{kind}"), subset.cast("int") + 1)

    def shapley(name: str) -> Column:
        bit = _bit(name)
        times = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return sum((times(s) * (at("n", F.lit(s)) - at("n", F.lit(s | bit))) for s in range(SUBSETS) if not s & bit), F.lit(0))

    counts = counts.withColumn("total", F.array(*(shapley(x) for x in FILTERS)))
    table = F.arrays_zip(*(F.lit(list(x)) for x in zip(*_steps(), strict=True)))
    order, step, before, bit = (F.col("x")[str(k)] for k in range(4))
    with_ = before + bit
    out = counts.select("part", "s", "total", F.explode(table).alias("x"))
    removed = at("n", before) - at("n", with_)
    return out.select(
        "part", order.alias("filter_order"), step.cast("int").alias("step"), at("n", with_).alias("kept"), removed.alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - removed).alias("redundant"), (at("n", F.lit(every) - bit) - at("n", F.lit(every))).alias("unique_fails"),
        (at("good", before) - at("good", with_)).alias("good_lost"), (at("toxic", before) - at("toxic", with_)).alias("toxic_lost"), F.element_at("total", (F.log2(bit) + 1).cast("int")).cast("long").alias("shapley"),
    )
