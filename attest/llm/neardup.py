"""Near-duplicate classes of whole texts: consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of five words (lower case). The weight of a shingle in a text is
(1 + ln tf) x (1 + IDF_SHARE x idf), with idf scaled to 0..1. Document frequencies come from all
texts, counted in a sketch of fixed size (SKETCH hashed counters, less what other shingles add to a
counter in the mean): a size that can be sent to every task, whatever the corpus. IDF_SHARE is small
because a group of thousands of near copies makes its own shingles frequent; with a large share their
common part would weigh so little that copies at 0.84 of plain similarity fell below 0.8.

Sampling is improved consistent weighted sampling: of each text SAMPLES samples (shingle and
level) whose agreement in two texts has the probability of their weighted Jaccard similarity.

Candidates. Texts that agree in all ROWS samples of a band share a bucket. Equal texts are one node
before that, so only different texts are compared.
 - The member of a bucket that has most companions over all bands is its leader; every member is
   paired with it and measured. A group of copies of one original has the original as its leader.
 - Then all members of a bucket that don't hang together yet are compared with one another, in buckets
   of any size: those outside the largest root of the bucket ask, all answer. Members are dealt into
   blocks of about SMALL texts and BLOCK_CHARS characters, and every block that asks meets every block
   that answers in a group of its own, so no pair is left out and no task grows with a bucket. A pair
   that shares several buckets is compared in the one of least key.
 - A pair counts if its samples agree in at least AGREE places. Groups keep the members that have such a
   partner; these get their texts, and pairs are verified where they are, the likeliest first, without
   pairs that hang together by then. So what comes out of a group is a forest, not its pairs.
Verified is the weighted Jaccard similarity of whole texts, at least THRESHOLD. Verified links are joined
to classes by alternating star steps. Nothing else changes with the size of the input or of a bucket, and
classes are those of comparing all pairs that share a bucket. Joins on keys that a large group makes hot
have written tables on both sides, which Spark splits when they are skewed.

Defined results: equal texts always share a class; a text of fewer than five words has one shingle; a
text without words equals only itself; a null text is a class of its own; class_id is the least doc_id
of the class (null if all are null). Repeated rows are copies; an empty table has no classes. Ties for
leader go to the greater hash of the text, which changes no class. Texts of any length are compared whole.
Other columns pass through in ``kept``, whatever their names.
"""

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import steps, tree_sum, written
from ._text import mixed, shingles

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 12
#: More samples than the bands use: the others tell pairs near the threshold from those below it.
SAMPLES = 96
#: Places in which the samples of a pair agree at least, to be verified: at 0.8, one pair in a thousand agrees in fewer.
AGREE = 65
#: The same for a pair with a leader: also measured is what is less near, as the distance bounds that of other pairs.
AGREE_LEADER = 32
SKETCH_BITS = 20
BLOCK = 1 << 15
IDF_SHARE = 0.1
#: Members of a block of a bucket, in the mean, and characters of their texts.
SMALL, BLOCK_CHARS = 512, 8_000_000
#: Ids that are sent to all executors at most to pick their rows (24 bytes each); with more of them the rows are shuffled.
SENT = 250_000


# --- weights ---


def _slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - SKETCH_BITS)).astype("int64")


def idf_table(docs: DataFrame) -> np.ndarray:
    """Rows with text -> 1 + IDF_SHARE x idf of every counter of the sketch (float32)."""
    def count(batches):
        from pyspark import TaskContext

        sums, n = np.zeros(1 << SKETCH_BITS, "int64"), 0
        for batch in batches:
            for rows in steps(batch, "text"):
                found = [h for h, _ in shingles(rows["text"].str.lower().tolist(), WORDS) if len(h)]
                n += len(found)
                if found:
                    at, times = np.unique(_slot(np.concatenate(found)), return_counts=True)
                    sums[at] += times
        part = TaskContext.get().partitionId()
        blocks = [(i, sums[i * BLOCK : (i + 1) * BLOCK]) for i in range(len(sums) // BLOCK)]
        blocks = [(-1, np.array([n], "int64")), *((i, x) for i, x in blocks if x.any())]
        yield pd.DataFrame({"block": [i for i, _ in blocks], "part": part, "counts": [x.astype("<i8").tobytes() for _, x in blocks]})

    # A few sums for each core, not one for each split of the input.
    few = 2 * docs.sparkSession.sparkContext.defaultParallelism
    texts = docs.select("text").filter("text is not null").coalesce(few)
    parts = written(texts.mapInPandas(count, "block int, part long, counts binary"), "shingle-counts")
    sums, n = np.zeros(1 << SKETCH_BITS), 1
    for row in tree_sum(parts, ["block"], "counts").collect():  # 8 MB, whatever the corpus
        if row["block"] < 0:
            n = max(1, int(np.frombuffer(row["counts"], "<i8")[0]))
        else:
            sums[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], "<i8")
    df = np.clip(sums - (sums.sum() - sums) / (len(sums) - 1), 1, n)
    return (1 + IDF_SHARE * np.log((1 + n) / (1 + df)) / np.log(1 + n)).astype("float32")


def weighted(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text, in order, and their weights."""
    return [(h, (1 + np.log(n)) * idf[_slot(h)]) for h, n in shingles([x.lower() for x in texts], WORDS)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the smaller weights over sum of the larger."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(a[1].sum() + b[1].sum() - both, 1e-30))


# --- samples ---


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) variates at the middles of 4096 equal shares, and their logarithms."""
    x = np.linspace(0, 20, 400_001)
    at = np.interp((np.arange(4096) + 0.5) / 4096, 1 - (1 + x) * np.exp(-x), x)
    return at.astype("float32"), np.log(at).astype("float32")


def samples(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Consistent weighted samples of texts that each have a shingle: uint32, texts x SAMPLES."""
    gamma, log_gamma = _tables()
    h = np.concatenate([x for x, _ in found])
    log_w = np.log(np.concatenate([w for _, w in found])).astype("float32")
    size = np.array([len(x) for x, _ in found])
    first = np.zeros(len(size), "int64")
    np.cumsum(size[:-1], out=first[1:])
    out = np.empty((len(found), SAMPLES), "uint32")
    for k in range(SAMPLES):
        salt = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
        x = (h ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        r = gamma[(x >> np.uint64(52)).astype("int64")]
        beta = ((x >> np.uint64(24)) & np.uint64(0xFFFF)).astype("float32") * np.float32(1 / 65536)
        level = np.floor(log_w / r + beta)
        cost = log_gamma[((x >> np.uint64(40)) & np.uint64(4095)).astype("int64")] - r * (level - beta + 1)
        least = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, first), size))
        at = least[np.searchsorted(least, first)]
        out[:, k] = (mixed(h[at] + level[at].astype("int64").astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(32)).astype("uint32")
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    """A key for each band: int64, texts x BANDS."""
    key = np.zeros((len(sample), BANDS), "uint64")
    parts = sample[:, : BANDS * ROWS].reshape(len(sample), BANDS, ROWS).astype("uint64")
    for r in range(ROWS):
        key = mixed(key + parts[:, :, r] + np.arange(1, BANDS + 1, dtype="uint64"))
    return key.view("int64")


def sampled(docs: DataFrame, idf) -> DataFrame:
    """Rows with doc_id, node and text -> doc_id, node, sig (a byte of each sample) and keys; both null without words."""
    def one(batches):
        for batch in batches:
            for rows in steps(batch, "text"):
                found = weighted(rows["text"].fillna("").tolist(), idf.value)
                some = [i for i, (h, _) in enumerate(found) if len(h)]
                sig, keys = [None] * len(found), [None] * len(found)
                if some:
                    sample = samples([found[i] for i in some])
                    for i, s, k in zip(some, (sample & 255).astype("uint8"), bands(sample), strict=True):
                        sig[i], keys[i] = s.tobytes(), k
                yield pd.DataFrame({"id": rows["id"], "no_id": rows["no_id"], "node": rows["node"], "chars": rows["text"].str.len().fillna(0).astype("int64"), "sig": sig, "keys": keys})

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "node", "text")
    out = rows.mapInPandas(one, "id long, no_id boolean, node binary, chars long, sig binary, keys array<bigint>")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "node", "chars", "sig", "keys")


# --- candidates ---


def _agreement(a: str, b: str):
    """In how many places two columns of samples agree."""
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(s), "uint8").reshape(len(s), SAMPLES) for s in (x, y))
        return pd.Series((p == q).sum(1).astype("int32"))

    return F.pandas_udf(count, "int")(a, b)


def _grouped(batches, by: list[str]):
    """The groups of rows that come in order of their keys, one at a time."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        new = (batch[by] != batch[by].shift()).any(axis=1).to_numpy()
        if held:
            new[0] = any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in by)
        cut = np.flatnonzero(new)
        if held and len(cut) and cut[0] == 0 or not held:
            cut = cut[cut > 0]
            if held and new[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
        for a, z in zip([0, *cut], [*cut, len(batch)], strict=True):
            if a:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[a:z])
    if held:
        yield pd.concat(held, ignore_index=True)


def _candidates(group: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(agreement, i, j) of the rows of a group that may be similar: i asks, j is any other.

    Left out are pairs that need no look here: members of one root hang together already; pairs with a
    leader are measured; pairs with a common bucket of a lesser key are compared there; two that both ask
    meet twice, once counts; and two whose distances (1 - similarity, a metric) from one leader of both
    differ by more than 1 - THRESHOLD are further apart than that.
    """
    key, nodes, roots = group["key"].iloc[0], group["node"].tolist(), np.unique(group["root"].tolist(), return_inverse=True)[1]
    sig = np.frombuffer(b"".join(group["sig"]), "uint8").reshape(len(group), SAMPLES)
    keys = np.array(group["keys"].tolist())
    member = {"asks": group["asks"].to_numpy(bool), "answers": group["answers"].to_numpy(bool)}
    wants = group["wants"].to_numpy(bool)
    out, far = [], {}
    for i in np.flatnonzero(member["asks"]).tolist():
        agree = (sig == sig[i]).sum(1)
        for j in np.flatnonzero(member["answers"] & (roots != roots[i]) & (agree >= AGREE)).tolist():
            if wants[j] and nodes[j] < nodes[i] or keys[i][keys[i] == keys[j]].min() < key:
                continue
            for k in (i, j):
                if k not in far:
                    far[k] = dict(zip(group["pivots"].iloc[k], group["fars"].iloc[k], strict=True))
            x, y = far[i], far[j]
            if nodes[j] in x or nodes[i] in y or any(abs(x[z] - y[z]) > 1 - THRESHOLD + 1e-6 for z in x.keys() & y.keys()):
                continue
            out.append((int(agree[j]), i, j))
    return out


def buckets(nodes: DataFrame) -> DataFrame:
    """(node, sig, keys) -> members of shared buckets, with n, leader and lead, its sig."""
    n = BANDS * nodes.count()
    entries = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = written(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-sizes", n)
    # Samples come in for members of shared buckets only.
    shared = written(entries.join(sizes, "key"), "near-shared", n)
    n = shared.count()
    entries = written(shared.join(nodes.select("node", "sig"), "node"), "near-entries", n)
    central = entries.groupBy("node").agg(F.sum("n").alias("c"))
    lead = written(entries.select("key", "node", "sig").join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node", "sig")).alias("lead")), "near-leaders", n)
    return written(entries.join(lead, "key").select("key", "n", "node", "sig", F.col("lead.node").alias("leader"), F.col("lead.sig").alias("lead")), "near-led", n)


def leader_pairs(led: DataFrame) -> DataFrame:
    """Every member with its leader, once."""
    first = F.col("node") < F.col("leader")
    pairs = led.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.when(first, F.col("sig")).otherwise(F.col("lead")).alias("x"), F.when(first, F.col("lead")).otherwise(F.col("sig")).alias("y"))
    return written(pairs.distinct().filter(_agreement("x", "y") >= AGREE_LEADER).select("a", "b"), "near-lead", led.count())


_MEMBER = "key long, p int, q int, node binary, sig binary, keys array<bigint>, root binary, wants boolean, asks boolean, answers boolean, pivots array<binary>, fars array<double>"


def close_members(led: DataFrame, nodes: DataFrame, root: DataFrame, measured: DataFrame) -> DataFrame:
    """Groups of members of buckets that may be similar and don't hang together yet: rows of _MEMBER."""
    # How far a node is from its leaders: at most one for each of its buckets.
    apart = led.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "node", "leader").distinct().join(measured, ["a", "b"])
    apart = apart.groupBy("node").agg(F.collect_list("leader").alias("pivots"), F.collect_list(1 - F.col("sim")).alias("fars"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = led.filter("n > 2").select("key", "node").join(nodes.select("node", "chars"), "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    n = led.count()
    rows = written(rows, "near-rooted", n)
    # Every pair of two roots has a member outside the largest root: these ask, and are compared with all.
    roots = rows.groupBy("key", "root").agg(F.count("*").alias("count"), F.sum("chars").alias("chars"))
    roots = roots.groupBy("key").agg(F.max(F.struct("count", "root", "chars")).alias("top"), F.sum("count").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("roots"))
    blocks = lambda n, chars: F.ceil(F.greatest(n / SMALL, chars / BLOCK_CHARS)).cast("int")
    sizes = roots.filter("roots > 1").select("key", F.col("top.root").alias("top"), blocks(F.col("n"), F.col("chars")).alias("all"), blocks(F.col("n") - F.col("top.count"), F.col("chars") - F.col("top.chars")).alias("some"))
    rows = rows.join(written(sizes, "near-bucket-sizes", n), "key").withColumn("wants", F.col("root") != F.col("top"))
    rows = rows.withColumns({"p": F.pmod(F.xxhash64("node"), F.col("some")).cast("int"), "q": F.pmod(F.xxhash64("node", F.lit(1)), F.col("all")).cast("int")})
    # A member that asks goes to all groups of its block that asks; every member answers in all groups of its other block.
    to = F.array_union(F.when(F.col("wants"), F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda q: F.struct(F.col("p").alias("p"), q.alias("q")))).otherwise(none("struct<p:int,q:int>")), F.transform(F.sequence(F.lit(0), F.col("some") - 1), lambda p: F.struct(p.alias("p"), F.col("q").alias("q"))))
    rows = rows.withColumn("to", F.explode(to)).withColumns({"asks": F.col("wants") & (F.col("to.p") == F.col("p")), "answers": F.col("to.q") == F.col("q")})
    rows = rows.select("key", "to.p", "to.q", "node", "root", "wants", "asks", "answers").join(nodes.select("node", "sig", "keys"), "node").join(apart, "node", "left")
    rows = rows.withColumns({"pivots": F.coalesce("pivots", none("binary")), "fars": F.coalesce("fars", none("double"))})
    names = [c.split()[0] for c in _MEMBER.split(", ")]
    by = ["key", "p", "q"]

    def some(batches):
        for group in _grouped(batches, by):
            found = _candidates(group)
            if found:
                yield group.iloc[sorted({k for _, i, j in found for k in (i, j)})][names]

    dealt = rows.select(*names).repartition(*by).sortWithinPartitions(*by, "node")
    return written(dealt.mapInPandas(some, _MEMBER), "near-close")


def close_links(members: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Verified links of the groups: enough of them that what is similar hangs together."""
    by = ["key", "p", "q"]

    def hold(batches):
        for group in _grouped(batches, by):
            nodes, texts, found, above = group["node"].tolist(), group["text"].tolist(), {}, {r: r for r in group["root"]}

            def top(r):
                while above[r] != r:
                    above[r] = r = above[above[r]]
                return r

            a, b = [], []
            for _, i, j in sorted(_candidates(group), key=lambda x: (-x[0], x[1:])):
                x, y = top(group["root"].iloc[i]), top(group["root"].iloc[j])
                if x == y:
                    continue
                for k in (i, j):
                    if k not in found:
                        found[k] = weighted([texts[k]], idf.value)[0]
                if similarity(found[i], found[j]) >= THRESHOLD:
                    above[x] = y
                    a.append(min(nodes[i], nodes[j]))
                    b.append(max(nodes[i], nodes[j]))
            yield pd.DataFrame({"a": a, "b": b})

    rows = members.join(texts, "node")
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "node")
    return written(dealt.mapInPandas(hold, "a binary, b binary"), "near-links")


def _picked(docs: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join; the keys go to the rows if they are few, else both are shuffled."""
    return docs.join(F.broadcast(keys) if keys.count() <= SENT else keys, on, how)


def texts_of(taking_part: DataFrame, docs: DataFrame, one_of_each: DataFrame) -> DataFrame:
    """One text for each node. docs: key, node, text; one_of_each: node and the key of one of its rows."""
    wanted = written(one_of_each.join(taking_part.distinct(), "node", "left_semi"), "near-texts-of", one_of_each.count())
    texts = _picked(docs, wanted, ["key", "node"], "left_semi").dropDuplicates(["node"])
    return written(texts.select("node", "text"), "near-texts")


def measured(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs with the similarity of their whole texts."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def hold(batches):
        cache: dict[bytes, tuple] = {}

        def of(node, text):
            if node not in cache:
                if len(cache) > 500:
                    cache.clear()
                cache[node] = weighted([text], idf.value)[0]
            return cache[node]

        for batch in batches:
            sim = [similarity(of(a, x), of(b, y)) for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True)]
            yield batch[["a", "b"]].assign(sim=sim)

    return both.select("a", "b", "x", "y").mapInPandas(hold, "a binary, b binary, sim double")


# --- classes ---


def components(links: DataFrame, most_steps: int = 100) -> DataFrame:
    """Links (a, b) -> (node, root): every node that has a link, with the least node of its component.

    Alternating star steps: each halves paths, and every step is written, so a lost executor costs one step.
    """
    n = links.count()
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", n)
    before = None
    for _ in range(most_steps):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "links-large", n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links", n)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def _key():
    """A text for each id, null too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", F.unhex(F.md5("text"))).withColumn("key", _key())


def classes(docs: DataFrame) -> DataFrame:
    """Documents with doc_id and text -> (doc_id, node, root, class_id) for every row."""
    docs = _with_key(docs.select("doc_id", "text"))
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(docs))  # 4 MB
    rows = written(sampled(docs, idf), "near-samples")
    n = rows.count()
    nodes = written(rows.filter("keys is not null").dropDuplicates(["node"]).select("node", "chars", "sig", "keys"), "near-nodes", 4 * n)
    keyed = written(rows.filter("keys is not null").groupBy("node").agg(F.min(_key()).alias("key")), "near-one-of-each", n)
    led = buckets(nodes)
    lead = leader_pairs(led)
    source = docs.select("key", "node", "text")
    ends = lead.select(F.explode(F.array("a", "b")).alias("node"))
    first = written(measured(lead, texts_of(ends, source, keyed), idf), "near-measured")
    links = first.filter(F.col("sim") >= THRESHOLD).select("a", "b")
    root = components(links)
    members = close_members(led, nodes, root, first)
    second = close_links(members, texts_of(members.select("node"), source, keyed), idf)
    if not second.isEmpty():
        root = components(links.unionByName(second))
    rooted = written(rows.select("doc_id", "node").join(written(root, "near-root", n), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots", n)
    named = written(rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id")), "near-named", n)
    return rooted.filter("root is not null").join(named, "root").select("doc_id", "node", "root", "class_id").unionByName(rooted.filter("root is null").select("doc_id", "node", "root", F.col("doc_id").alias("class_id")))


def kept(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id (any one of rows that are equal in id and text), with all columns."""
    found = written(classes(docs), "near-classes")
    n = found.count()
    names = docs.columns
    packed = _with_key(docs.select("doc_id", "text", F.struct(*names).alias("row")))
    with_text = found.filter("node is not null").withColumn("key", _key())
    # A null id comes after all others; classes without any id are told apart by their root.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"), F.col("key").alias("key"))
    first = written(with_text.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first"), "near-first", n)
    gone = with_text.join(first, "root")
    gone = written(gone.filter((F.col("key") != F.col("first.key")) | (F.col("node") != F.col("first.node"))).select("key", "node").distinct(), "near-gone", n)
    left = _picked(packed, gone, ["key", "node"], "left_anti")
    again = written(with_text.groupBy("key", "node").count().filter("count > 1").select("key", "node"), "near-again", n)
    if not again.isEmpty():  # rows of equal id and text: one of them stays
        left = _picked(left, again, ["key", "node"], "left_anti").unionByName(_picked(left, again, ["key", "node"], "left_semi").dropDuplicates(["key", "node"]))
    return left.select("row.*")
