"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source is expected e = target / source_size times in the mix. The whole part of e is allocated for
certain to each of its documents. The rest of the target is drawn: a document is included once more with
probability p = min(1, c x bits), where bits is the length of its size as a binary number, so longer texts
are likelier by a slow measure, and c makes the sum of p x size the rest of the target. Documents with
p = 1 are allocated for certain too. The others are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the lowest ranks are taken until the sample has the size that is left.
Size is counted in words, so the sample is fixed in what it adds to the mix. The last gap goes to the one
document further down whose size is nearest to it; that is a rounding, at most one document a source.

u comes from a hash of the document's id, so reruns and other partitionings agree.

No source is ordered in one task: ranks are cut into buckets whose number grows with the largest source, a
running sum over buckets places each bucket, and a window inside a bucket places its documents. c is found
from one row per source and number of bits. What
comes out is one row per source and number of bits, the cut; it is applied to the documents without moving them.

Defined results: a null text has size 0; a null source is a source; documents of equal id, source and
size are taken or left together; documents of a source without words have no copies; an empty table
gives an empty mix; texts of any length are counted whole; ties of rank go by doc_id, then size; other
columns stay as they are whatever their names, except those of the names that are added.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Weights of sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix over that of all documents.
SHARE = 1.5
#: Most copies of a source, and of a document.
MOST = 2
#: Documents that a bucket of ranks holds in the mean.
BUCKET = 128
#: Sources whose cuts (at most 64 rows each) are sent to all executors at most; with more of them the cuts are joined by a shuffle.
SMALL = 1_000

def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size): shares by weight of share x all sizes, none above most x its size.

    Sources in order of most x size / weight reach their limit first. With all before it at their
    limits, the level (what is left over what weight is left) decides whether the next one does too.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit_per_weight", "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    ranked = (
        sources.withColumn("place", F.row_number().over(named))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit_per_weight", most * F.col("source_size") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everyone))
        .withColumn("all_weight", F.sum("weight").over(everyone))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (share * F.col("all_size") - most * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before")))
        # The first source in that order that stays within its limit has the level of all that follow.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("limit_per_weight"), F.struct("limit_per_weight", "place", "level"))).over(everyone)["level"])
    )
    limit = F.col("source_size") * F.lit(float(most))
    return ranked.select("source", "source_size", "weight", F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of a key and a seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def bits(size: Column) -> Column:
    """The length of a size as a binary number."""
    return F.length(F.bin(size)).cast("long")


def inclusion(classes: DataFrame) -> DataFrame:
    """(source, bits, class_size, rest) -> with p, the probability of one more copy, and left, what is to be drawn of rest.

    Classes reach p = 1 from the longest texts down. With all longer ones at 1, c of a class follows from
    what is left; the first class that stays at 1 or below has the c of all that follow.
    """
    down = Window.partitionBy("source").orderBy(F.col("bits").desc())
    longer, others = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("rest") - F.coalesce(F.sum("class_size").over(longer), F.lit(0))
    within = Window.partitionBy("source")
    ranked = classes.withColumn("left", left).withColumn("c", F.try_divide(F.col("left"), F.sum(F.col("bits") * F.col("class_size")).over(others)))
    ranked = ranked.withColumn("at", F.max(F.when(F.col("c") * F.col("bits") <= 1, F.struct("bits", "c", "left"))).over(within))
    p = F.when(F.col("rest") <= 0, F.lit(0.0)).when(F.col("bits") > F.col("at.bits"), F.lit(1.0)).otherwise(F.coalesce(F.col("at.c") * F.col("bits"), F.lit(0.0)))
    return ranked.select("source", "bits", p.alias("p"), F.coalesce("at.left", F.lit(0.0)).alias("left"))


def _rank(seed: int) -> tuple[Column, Column]:
    """u and rank of rows that have doc_id and p."""
    u = uniform(F.col("doc_id"), seed)
    return u, F.when((F.col("p") > 0) & (F.col("p") < 1), u / (1 - u) / (F.col("p") / (1 - F.col("p")))).otherwise(u)


def _key(rank: Column) -> Column:
    return F.struct(rank.alias("rank"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))


def cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """(doc_id, source, size) -> per source and bits: source_size, target, whole, p, and the last ranks that are in: cut, and one more, last."""
    classes = written(sized.groupBy("source", bits(F.col("size")).alias("bits")).agg(F.sum("size").alias("class_size"), F.count("*").alias("n")), "mix-classes")
    sums = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(sums, weights, share, most).withColumn("e", e).withColumn("whole", F.floor("e"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select(F.col("source").alias("s"), "source_size", "target", "whole", "rest"), "mix-plan")
    largest, n = classes.groupBy("source").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    near = F.broadcast if n <= SMALL else (lambda df: df)
    buckets = max(1, min(1 << 20, -(-largest // BUCKET)))
    odds = written(inclusion(classes.join(near(plan), F.expr("source <=> s")).select("source", "bits", "class_size", "rest")).select(F.col("source").alias("s"), F.col("bits").alias("b"), "p", "left"), "mix-odds")

    near_odds = near  # at most 64 rows a source
    ranked = sized.withColumn("bits", bits(F.col("size"))).join(near_odds(odds), F.expr("source <=> s and bits = b")).filter("p > 0 and p < 1")
    # Ranks times the odds of an average document lie like u.
    average = odds.groupBy(F.col("s").alias("s2")).agg(F.avg(F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("p"))).alias("mean"))
    ranked = ranked.withColumn("rank", _rank(seed)[1]).join(near(average), F.expr("source <=> s2"))
    usual = F.col("rank") * F.col("mean") / (1 - F.col("mean"))
    ranked = ranked.withColumn("bucket", F.floor(usual / (1 + usual) * buckets)).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    ranked = written(ranked.select("name", "source", "bucket", "doc_id", "size", "rank", "left"), "mix-ranked")
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = ranked.groupBy("name", "bucket").agg(F.sum("size").alias("here")).withColumn("below", F.coalesce(F.sum("here").over(earlier), F.lit(0))).drop("here")
    inside = Window.partitionBy("name", "bucket").orderBy("rank", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranked.join(below, ["name", "bucket"]).withColumn("fits", F.col("below") + F.sum("size").over(inside) <= F.col("left"))
    placed = written(placed.select("source", "doc_id", "size", "rank", "left", "fits"), "mix-placed")
    cut = placed.groupBy("source").agg(F.max(F.when(F.col("fits"), _key(F.col("rank")))).alias("cut"), F.first("left").alias("left"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("filled"))
    cut = cut.select(F.col("source").alias("s2"), "cut", (F.col("left") - F.col("filled")).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    left_out = placed.filter("not fits and size > 0").join(near(cut.drop("cut")), F.expr("source <=> s2")).filter(off < F.col("gap"))
    last = left_out.groupBy(F.col("source").alias("s3")).agg(F.min_by(_key(F.col("rank")), F.struct(off, "rank", "doc_id", "size")).alias("last"))
    out = plan.join(odds.withColumnRenamed("s", "s1"), F.expr("s <=> s1")).join(cut, F.expr("s <=> s2"), "left").join(last, F.expr("s <=> s3"), "left")
    return written(out.select(F.col("s").alias("source"), F.col("b").alias("bits"), "source_size", "target", (F.col("whole") + F.when(F.col("p") >= 1, 1).otherwise(0)).alias("whole"), "p", "cut", "last"), "mix-cuts")


def apply(docs: DataFrame, cut: DataFrame, seed: int = 7) -> DataFrame:
    """Adds source_size, target, copies and taken to documents that have doc_id, source and size, where they lie."""
    near = F.broadcast if cut.count() <= 64 * SMALL else (lambda df: df)
    old = [c for c in docs.columns if c.lower() not in ("source_size", "target", "copies", "taken")]
    docs = docs.select("doc_id", "source", "size", F.struct(*old).alias("row"), bits(F.col("size")).alias("bits"))
    docs = docs.join(near(cut.withColumnsRenamed({"source": "s", "bits": "b"})), F.expr("source <=> s and bits = b"))
    key = _key(_rank(seed)[1])
    chosen = (F.col("p") > 0) & (F.col("p") < 1) & (F.coalesce(key <= F.col("cut"), F.lit(False)) | F.coalesce(key == F.col("last"), F.lit(False)))
    docs = docs.withColumn("copies", F.col("whole") + F.when(chosen, 1).otherwise(0))
    return docs.select("row.*", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """Documents with columns doc_id, text and source -> doc_id, source, size, source_size, target, copies, taken."""
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    seed = {k: v for k, v in how.items() if k == "seed"}
    return apply(sized, cuts(sized, **how), **seed)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs; texts don't move between executors."""
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    cut = cuts(sized, **how)
    names = docs.columns
    packed = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.struct(*names).alias("row"))
    out = apply(packed, cut, **{k: v for k, v in how.items() if k == "seed"})
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
