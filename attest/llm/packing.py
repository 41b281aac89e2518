"""Best-fit packing under conflicts: pieces of documents into bins of one capacity.

A bin never holds two pieces of one source or of one cluster of copies. Pieces are taken from the
largest down. Open bins are kept in order of what is left in them; each carries one bitmap of its
sources and one of its clusters. The search for a bin starts at the tightest that is large enough and
goes on to the next one until both bitmaps are clear of the piece, so the bin found is the tightest
compatible one; if there is none a new bin is opened.

A document larger than a bin gives full pieces, each a bin of its own, and a rest that is packed.

Documents are dealt by a hash of their id to shards of about SHARD documents, whose number grows with
the table, so no source or cluster meets in one task. Only ids, sizes and names are shuffled.

Defined results: a null or empty text has size 0 and fits any compatible bin; null source or cluster
conflicts with nothing; rows that are equal are packed each; ties go by doc_id, then by cluster.
"""

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .mixing import size_of

#: Words that a bin holds.
CAPACITY = 2048
#: Documents that are packed together, in the mean.
SHARD = 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Of each piece, in the order given: its bin and where it starts in it. sources and clusters: bitmaps with one bit or none."""
    left: list[tuple[int, int]] = []  # (what is left, bin), in order
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, starts = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect_left(left, (size, -1))
        while at < len(left):
            b = left[at][1]
            if not (source_bits[b] & source or cluster_bits[b] & cluster):
                break
            at += 1
        if at < len(left):
            rest, b = left.pop(at)
        else:
            rest, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        bins.append(b)
        starts.append(capacity - rest)
        source_bits[b] |= source
        cluster_bits[b] |= cluster
        insort(left, (rest - size, b))
    return bins, starts


def _bits(names: pd.Series) -> list[int]:
    """One bit for each name that occurs more than once; a name that occurs once, or null, can't conflict."""
    codes = pd.factorize(names.where(names.duplicated(keep=False)))[0]
    return [0 if c < 0 else 1 << c for c in codes.tolist()]


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id long, size, source, cluster) -> a row per piece: doc_id, piece, piece_size, bin_id, bin_start."""
    n_shards = max(1, -(-docs.count() // shard))
    dealt = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("size").cast("long").alias("size"), "source", F.col("cluster").cast("string").alias("cluster"),
        F.pmod(F.xxhash64("doc_id", "size", "cluster", F.lit(11)), F.lit(n_shards)).alias("shard"),
    )

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        full = rows["size"] // capacity
        rows = rows.assign(full=full, rest=rows["size"] - full * capacity)
        rows = rows.sort_values(["rest", "id", "cluster", "source"], ascending=[False, True, True, True], kind="stable")
        tail = rows[(rows["rest"] > 0) | (rows["size"] == 0)]
        bins, starts = best_fit(tail["rest"].tolist(), _bits(tail["source"]), _bits(tail["cluster"]), capacity)
        tail = tail.assign(piece=tail["full"], piece_size=tail["rest"], bin=bins, bin_start=starts)
        head = rows.loc[rows.index.repeat(rows["full"])]
        head = head.assign(piece=head.groupby(level=0).cumcount(), piece_size=capacity, bin=np.arange(len(head)) + max(bins, default=-1) + 1, bin_start=0)
        out = pd.concat([tail, head], ignore_index=True)
        bin_id = out["shard"].astype(str) + "-" + out["bin"].astype(str)
        return pd.DataFrame({"doc_id": out["id"].astype("Int64").mask(out["no_id"]), "piece": out["piece"], "piece_size": out["piece_size"], "bin_id": bin_id, "bin_start": out["bin_start"]})

    return dealt.groupBy("shard").applyInPandas(one, "doc_id long, piece long, piece_size long, bin_id string, bin_start long")


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Documents with doc_id, text and source -> pieces in bins. A cluster is all texts that are equal but for case and white space."""
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), "source", F.when(plain != "", F.xxhash64(plain)).alias("cluster"))
    return pack(written(rows, "pack-sizes"), capacity, shard)
