"""Ranked lexical search: MaxScore with bounds of term pairs, over shards of documents.

A shard is a run of documents of about SHARD_CHARS characters, as they lie in the input: its terms, their
postings (document and occurrences) and the lengths of its documents, one row of a written table. No text
is shuffled. From the shards come the counts of documents N and of terms L, and of each searched term its
document frequency; with these a second table is written for a block of items: the postings of their terms
with their scores (impacts), each term's largest, and for pairs of terms that are next to each other in an
item, ordered by weight, their intersection: its documents and the largest joint impact.

A query sorts the item's terms by weight, least first. The score that the first j of them can give is
bounded by the largest impacts, two neighbours together by their joint maximum where that is less than
the sum of their own: bound[j] = min(bound[j-1] + max[j], bound[j-2] + pair[j-1, j]), where pair is the
largest of the joint maximum and either alone. Terms whose bound stays below the threshold cannot put a
document among the first k by themselves, so only documents of the other terms are candidates; then term
by term, from the heaviest down, candidates go that cannot reach the threshold with what is left. The
threshold is the k-th score so far: at first that of the documents in the item's rarest intersections,
scored in all shards beforehand. Documents that reach it exactly stay, as ties go by doc_id. So results are
those of scoring every document. A shard whose whole bound is below the threshold is not looked into.

Each task hands on k documents of an item at most, and Spark ranks these. Items are taken in blocks of ITEMS, and
a block's terms go to the tasks at once: a benchmark is a set of queries against all documents.

Defined results: a null text has no terms and is found by nothing, nor is an empty one; an item without terms
finds nothing. Equal scores go by ascending doc_id, null ids last. Equal rows rank one after another, in no
order that shows. Two items of the same id are ranked each by itself, and so are two equal items.
Terms, texts and items are taken whole, whatever their length. Empty tables give no rows; other columns don't matter.
"""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

K = 10
#: Characters of a shard; a longer text is a shard of its own.
SHARD_CHARS = 4 << 20
#: Items that are searched at once.
ITEMS = 1024
#: Impact of a term: weight x (SCALE x tf) div (TF x tf + NORM x m), m = BASE + (SLOPE x n x N) div L (fixed values).
SCALE, TF, NORM, BASE, SLOPE = 1_000_000_000, 1000, 8, 10, 90

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower())


# --- shards ---

_SHARD = "shard long, ids binary, none binary, lengths binary, terms binary, starts binary, docs binary, times binary"


def _packed(shard: int, ids: list, texts: list[str]) -> dict:
    """A row of _SHARD. Documents without terms are left out."""
    vocabulary: dict[bytes, int] = {}
    which, times, owner, lengths, kept = [], [], [], [], []
    for i, text in zip(ids, texts, strict=True):
        found = terms(text)
        if not found:
            continue
        counts = Counter(found)
        which += [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
        times += counts.values()
        owner += [len(kept)] * len(counts)
        lengths.append(len(found))
        kept.append(i)
    names = sorted(vocabulary)
    rank = np.empty(len(names), "int64")
    rank[[vocabulary[t] for t in names]] = np.arange(len(names))
    which = rank[np.array(which, "int64")]
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(names) + 1)).astype("<i4")
    return {
        "shard": shard, "ids": np.array([0 if i is None else i for i in kept], "<i8").tobytes(), "none": np.array([i is None for i in kept], "?").tobytes(), "lengths": np.array(lengths, "<i4").tobytes(),
        "terms": b"\n".join(names), "starts": starts.tobytes(), "docs": np.array(owner, "<i4")[order].tobytes(), "times": np.array(times, "<i4")[order].tobytes(),
    }


def index(docs: DataFrame) -> DataFrame:
    """Documents with doc_id and text -> the written table of shards, every document and every term."""
    def shards(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, none, text in zip(batch["id"].tolist(), batch["no_id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(None if none else i)
                texts.append(text)
                chars += len(text)
                if chars >= SHARD_CHARS:
                    yield pd.DataFrame([_packed(number, ids, texts)])
                    ids, texts, chars, number = [], [], 0, number + 1
        if ids:
            yield pd.DataFrame([_packed(number, ids, texts)])

    rows = docs.filter("text is not null").select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    return written(rows.mapInPandas(shards, _SHARD), "lexical-shards")


@dataclass
class Shard:
    """One row of the index."""

    ids: np.ndarray
    none: np.ndarray
    lengths: np.ndarray
    terms: list[bytes]
    starts: np.ndarray
    docs: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(row) -> "Shard":
        number = lambda x: np.frombuffer(x, "<i4")
        return Shard(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["none"], "?"), number(row["lengths"]), row["terms"].split(b"\n") if row["terms"] else [], number(row["starts"]), number(row["docs"]), number(row["times"]))


# --- items ---


@dataclass
class Items:
    """A block of items: each one's terms as places in a sorted vocabulary."""

    item_ids: list
    vocabulary: list[bytes]
    terms: list[np.ndarray]


def item_blocks(items: DataFrame) -> DataFrame:
    """Items with item_id and text -> a written table with a row for each ITEMS of them (or fewer): item_ids and texts."""
    def blocks(batches):
        ids, texts = [], []
        for batch in batches:
            for i, none, text in zip(batch["id"].tolist(), batch["no_id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(None if none else i)
                texts.append(text)
                if len(ids) == ITEMS:
                    yield pd.DataFrame({"ids": [ids], "texts": [texts]})
                    ids, texts = [], []
        if ids:
            yield pd.DataFrame({"ids": [ids], "texts": [texts]})

    rows = items.filter("text is not null").select(F.coalesce("item_id", F.lit(0)).cast("long").alias("id"), F.col("item_id").isNull().alias("no_id"), "text")
    found = written(rows.mapInPandas(blocks, "ids array<long>, texts array<string>"), "lexical-items")
    return written(found.withColumn("block", F.monotonically_increasing_id()), "lexical-blocks")


def items_of(ids: list, texts: list[str]) -> Items:
    found = [sorted(set(terms(t))) for t in texts]
    vocabulary = sorted(set().union(*found))
    place = {t: k for k, t in enumerate(vocabulary)}
    return Items(list(ids), vocabulary, [np.array([place[t] for t in x], "int64") for x in found])


# --- impacts and pairs ---


@dataclass
class Weighted:
    """A block of items with the weights of their terms, and the pairs of neighbours in each item's order."""

    items: Items
    weights: np.ndarray
    n_docs: int
    n_terms: int
    orders: list[np.ndarray]
    pairs: np.ndarray
    pair_of: list[np.ndarray]


def weighted(items: Items, df: np.ndarray, n_docs: int, n_terms: int) -> Weighted:
    """Weights from document frequencies; each item's terms of some weight, the lightest first, and its pairs."""
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype("int64")
    orders = []
    for own in items.terms:
        own = own[(df[own] > 0) & (weights[own] > 0)]
        orders.append(own[np.lexsort((own, weights[own]))])
    size = len(items.vocabulary)
    both = [np.minimum(o[:-1], o[1:]) * size + np.maximum(o[:-1], o[1:]) for o in orders]
    pairs = np.unique(np.concatenate([np.zeros(0, "int64"), *both]))
    return Weighted(items, weights, n_docs, n_terms, orders, pairs, [np.searchsorted(pairs, x) for x in both])


_IMPACTS = "shard long, ids binary, none binary, starts binary, docs binary, impacts binary, pair_starts binary, pair_docs binary, pair_most binary"


def impacts(shard: Shard, block: Weighted) -> dict:
    """A row of _IMPACTS but for its shard: postings of the block's terms with their impacts, and the intersections of its pairs with their joint maxima."""
    place = {t: k for k, t in enumerate(shard.terms)}
    m = BASE + (SLOPE * shard.lengths.astype("int64") * block.n_docs) // max(1, block.n_terms)
    size, docs, found = [], [], []
    for k, t in enumerate(block.items.vocabulary):
        at = place.get(t)
        if at is None:
            size.append(0)
            continue
        own = slice(shard.starts[at], shard.starts[at + 1])
        d, tf = shard.docs[own], shard.times[own].astype("int64")
        size.append(len(d))
        docs.append(d)
        found.append(block.weights[k] * ((SCALE * tf) // (TF * tf + NORM * m[d])))
    starts = np.concatenate([[0], np.cumsum(size)]).astype("int64")
    docs = np.concatenate([np.zeros(0, "int32"), *docs])
    found = np.concatenate([np.zeros(0, "int64"), *found])
    n, here, score = len(block.items.vocabulary), np.zeros(len(shard.ids), bool), np.zeros(len(shard.ids), "int64")
    pair_size, pair_docs, most, last = [], [], [], -1
    for p in block.pairs.tolist():
        a, b = divmod(p, n)
        if a != last:
            if last >= 0:
                here[docs[starts[last] : starts[last + 1]]] = False
            own = slice(starts[a], starts[a + 1])
            here[docs[own]] = True
            score[docs[own]] = found[own]
            last = a
        own = slice(starts[b], starts[b + 1])
        shared = here[docs[own]]
        d = docs[own][shared]
        pair_size.append(len(d))
        pair_docs.append(d)
        most.append(int((score[d] + found[own][shared]).max()) if len(d) else 0)
    return {
        "ids": shard.ids.tobytes(), "none": shard.none.tobytes(), "starts": starts.astype("<i8").tobytes(), "docs": docs.astype("<i4").tobytes(), "impacts": found.astype("<i8").tobytes(),
        "pair_starts": np.concatenate([[0], np.cumsum(pair_size)]).astype("<i8").tobytes(), "pair_docs": np.concatenate([np.zeros(0, "int32"), *pair_docs]).astype("<i4").tobytes(), "pair_most": np.array(most, "<i8").tobytes(),
    }


class Prepared:
    """One row of impacts, ready for queries."""

    def __init__(self, row):
        long = lambda x: np.frombuffer(x, "<i8")
        self.ids, self.none = long(row["ids"]), np.frombuffer(row["none"], "?")
        self.starts, self.docs, self.impacts = long(row["starts"]), np.frombuffer(row["docs"], "<i4"), long(row["impacts"])
        self.pair_starts, self.pair_docs, self.pair_most = long(row["pair_starts"]), np.frombuffer(row["pair_docs"], "<i4"), long(row["pair_most"])
        self.score = np.zeros(len(self.ids), "int64")
        some = np.flatnonzero(np.diff(self.starts))
        self.most = np.zeros(len(self.starts) - 1, "int64")
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impacts, self.starts[:-1][some])

    def add(self, term: int, candidates: np.ndarray | None = None) -> np.ndarray:
        """Adds a term's impacts to the scores, of all its documents or of candidates (in order); the documents that it added to."""
        own = slice(self.starts[term], self.starts[term + 1])
        docs, impact = self.docs[own], self.impacts[own]
        if candidates is not None and 8 * len(candidates) < len(docs):
            at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
            hit = docs[at] == candidates
            docs, impact = candidates[hit], impact[at[hit]]
        self.score[docs] += impact
        return docs

    def bounds(self, order: np.ndarray, pairs: np.ndarray, with_pairs: bool = True) -> np.ndarray:
        """What the first j terms of an order can score together, for each j from 0."""
        most, joint = self.most[order].tolist(), self.pair_most[pairs].tolist()
        out = [0]
        for j, x in enumerate(most):
            bound = out[-1] + x
            if with_pairs and j:
                bound = min(bound, out[-2] + max(joint[j - 1], most[j - 1], x))
            out.append(bound)
        return np.array(out)

    def seeds(self, order: np.ndarray, pairs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best documents of the intersections of an item's heaviest pairs that hold k, or of its heaviest term's, with their scores."""
        docs = np.zeros(0, "int32")
        for p in pairs[::-1].tolist():
            docs = np.union1d(docs, self.pair_docs[self.pair_starts[p] : self.pair_starts[p + 1]])
            if len(docs) >= k:
                break
        if len(docs) < k:
            for term in order[::-1].tolist():
                docs = np.union1d(docs, self.docs[self.starts[term] : self.starts[term + 1]])
                if len(docs) >= k:
                    break
        docs = docs.astype("int64")
        for term in order.tolist():
            self.add(term, docs)
        score = self.score[docs].copy()
        self.score[:] = 0
        return self.top(docs, score, k)

    def top(self, docs: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k documents first in order: score, then id."""
        if len(docs) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            docs, score = docs[score >= kth], score[score >= kth]
        first = np.lexsort((self.ids[docs], self.none[docs], -score))[:k]
        return docs[first], score[first]

    def search(self, order: np.ndarray, pairs: np.ndarray, threshold: int, k: int, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """The first k documents among those that reach the threshold, their scores, and how many candidates there were."""
        bound = self.bounds(order, pairs, with_pairs)
        none = np.zeros(0, "int64")
        if bound[-1] < max(1, threshold):
            return none, none, 0
        # The first terms, as many as can't reach the threshold together, make no candidates.
        left = int(np.flatnonzero(bound < max(1, threshold))[-1])
        touched = [self.add(t) for t in order[left:].tolist()]
        docs = np.flatnonzero(self.score)
        n = len(docs)
        for j in range(left, 0, -1):
            docs = docs[self.score[docs] + bound[j] >= threshold]
            if not len(docs):
                break
            touched.append(self.add(order[j - 1], docs))
        score = self.score[docs]
        keep = score >= max(1, threshold)
        out = self.top(docs[keep], score[keep].copy(), k)
        for x in touched:
            self.score[x] = 0
        return *out, n


# --- jobs ---


def _statistics(shards: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and their terms."""
    def count(batches):
        for batch in batches:
            found = [np.frombuffer(x, "<i4") for x in batch["lengths"]]
            yield pd.DataFrame({"n": [sum(map(len, found))], "l": [int(sum(int(x.sum()) for x in found))]})

    n, l = shards.select("lengths").mapInPandas(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, l or 0


def _frequencies(shards: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each term of the items is."""
    sent = shards.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches):
        for batch in batches:
            for names, starts in zip(batch["terms"], batch["starts"], strict=True):
                place = {t: k for k, t in enumerate(names.split(b"\n"))} if names else {}
                size = np.diff(np.frombuffer(starts, "<i4"))
                found = [(k, size[place[t]]) for k, t in enumerate(sent.value) if t in place]
                yield pd.DataFrame(found, columns=["term", "n"])

    out = np.zeros(len(items.vocabulary), "int64")
    for row in shards.select("terms", "starts").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        out[row["term"]] = row["n"]
    return out


def _tops(rows: DataFrame, of, k: int) -> DataFrame:
    """Runs a function over prepared shards: (Prepared, item) -> documents and scores; each task hands on its k first of each item."""
    def run(batches):
        held: dict[int, pd.DataFrame] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                shard = Prepared(row)
                for item, (docs, score) in of(shard, {i: int(x["score"].iloc[-1]) for i, x in held.items() if len(x) == k}):
                    if len(docs):
                        new = pd.DataFrame({"item": item, "id": shard.ids[docs], "no_id": shard.none[docs], "score": score})
                        held[item] = (pd.concat([held[item], new]) if item in held else new).sort_values(["score", "no_id", "id"], ascending=[False, True, True]).head(k)
        if held:
            yield pd.concat(held.values())

    return rows.mapInPandas(run, "item long, id long, no_id boolean, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(shards: DataFrame, items: Items, n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """A block of items against all shards -> item, item_id, rank, doc_id, score; written."""
    spark = shards.sparkSession
    block = weighted(items, _frequencies(shards, items), n_docs, n_terms)
    sent = spark.sparkContext.broadcast(block)

    def prepare(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame([{"shard": row["shard"]} | impacts(Shard.of(row), sent.value)])

    prepared = written(shards.mapInPandas(prepare, _IMPACTS), "lexical-impacts")

    def seed(shard, held):
        b = sent.value
        return [(i, shard.seeds(order, pairs, k)) for i, (order, pairs) in enumerate(zip(b.orders, b.pair_of, strict=True)) if len(order)]

    least = _ranked(_tops(prepared, seed, k), k).filter(F.col("rank") == k).select("item", "score").collect()  # a row for each item of the block
    reach = spark.sparkContext.broadcast({r["item"]: r["score"] for r in least})

    def look(shard, held):
        b = sent.value
        for i, (order, pairs) in enumerate(zip(b.orders, b.pair_of, strict=True)):
            if len(order):
                yield i, shard.search(order, pairs, max(reach.value.get(i, 1), held.get(i, 1)), k)[:2]

    found = _ranked(_tops(prepared, look, k), k)
    ids = F.lit([0 if i is None else i for i in items.item_ids]), F.lit([i is None for i in items.item_ids])
    at = (F.col("item") + 1).cast("int")
    out = found.select("item", F.when(~F.element_at(ids[1], at), F.element_at(ids[0], at)).alias("item_id"), "rank", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "score")
    return written(out, "lexical-found")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Documents (doc_id, text) and items (item_id, text) -> item_id, rank, doc_id, score: the k first documents of each item."""
    spark = docs.sparkSession
    shards = index(docs)
    n_docs, n_terms = _statistics(shards)
    blocks = item_blocks(items)
    out = None
    for block in sorted(r["block"] for r in blocks.select("block").collect()):  # a number for each ITEMS of them
        row = blocks.filter(F.col("block") == block).first()
        found = search_block(shards, items_of(row["ids"], row["texts"]), n_docs, n_terms, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select("item_id", "rank", "doc_id", "score")
