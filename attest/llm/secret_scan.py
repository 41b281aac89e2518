"""Secrets in whole texts, told apart by who owns copies of them across the corpus.

Base spans, leftmost and not overlapping per kind: ``assign`` (a value given to a name such as
password or token, 12 characters or more), ``access`` (an AKIA key id of 18 or more) and ``hex`` (a run
of 16 or more). The candidate is the value: what is assigned, or the whole run.

Every candidate is hashed. Over the corpus a hash has so many distinct repositories and owners.
 - A value of SHARED_OWNERS owners or SHARED_REPOS repositories or more is a widely copied example.
 - Any other value is specific to its few owners. If it looks live (letters and digits mixed, entropy of
   LIVE_BITS or more a character, no word such as "example") it is a credential: the span of the value is
   added as ``live``.
Counts are taken in two steps, owner by owner and then over owners, after pairs of hash, owner and
repository are made distinct in each task: a value that a third of all documents hold gives one row
per owner and task. The counts go back to the spans by a join of two written tables, which Spark splits
where a value is frequent.

Defined results: a null text is empty and has no spans; a null owner or repository counts as one of
its own; positions are code points, ends exclusive; repeated rows are scanned each and count once;
other columns pass through in ``masked``.
"""

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

KINDS = ("assign", "access", "hex", "live")
#: Owners from which on a value is an example that people copy.
SHARED_OWNERS = 3
#: Repositories from which on it is one, whoever owns them.
SHARED_REPOS = 25
LIVE_BITS = 3.0
MASK = "<secret>"
#: Bytes of spans that are sent to all executors at most; with more of them texts and spans are shuffled.
SENT_BYTES = 16 << 20

_NAMES = ("passw", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DUMMY = ("example", "sample", "dummy", "placeholder", "changeme", "your")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the value starts), in order. A failing assignment still uses up its characters."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def looks_live(value: str) -> bool:
    low = value.lower()
    if any(x in low for x in _DUMMY) or not (re.search("[a-z]", low) and re.search("[0-9]", low)):
        return False
    share = np.unique(list(value), return_counts=True)[1] / len(value)
    return bool(-(share * np.log2(share)).sum() >= LIVE_BITS)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_FOUND = "row binary, owner string, repo string, starts array<int>, kinds array<int>, ends array<int>, values array<int>, hashes array<string>, live array<boolean>"


def found(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """A row for each document with its base spans and the hashes of their values."""
    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch["text"].fillna(""):
                spans = base_spans(text)
                values = [text[v:e] for _, _, e, v in spans]
                rows.append(([s for s, *_ in spans], [k for _, k, _, _ in spans], [e for _, _, e, _ in spans], [v for *_, v in spans], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()[:32] for x in values], [looks_live(x) for x in values]))
            out = pd.DataFrame(rows, columns=["starts", "kinds", "ends", "values", "hashes", "live"], index=batch.index)
            yield pd.concat([batch[["row", "owner", "repo"]], out], axis=1)

    rows = docs.select(F.col("row"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), "text")
    return rows.mapInPandas(scan, _FOUND)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owner, repo) -> per hash: distinct repositories (of an owner) and owners."""
    pairs = candidates.select("hash", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("-")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repo"), F.lit("-")).alias("repo")).distinct()
    return pairs.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scanned(docs: DataFrame, owner: str = "source", repo: str = "doc_id", shared: int = SHARED_OWNERS, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """Documents -> (row, spans array of struct(start, kind, end, is_shared), most_owners, most_repos) per row of docs that has a span.

    docs: text, owner, repo and row, a key that tells rows apart by what they hold.
    """
    base = written(found(docs, owner, repo).filter(F.size("starts") > 0), "secret-spans")
    each = base.select("row", "owner", "repo", F.explode(F.arrays_zip("starts", "kinds", "ends", "values", "hashes", "live")).alias("s")).select("row", "owner", "repo", "s.*").withColumnRenamed("hashes", "hash")
    owners = written(ownership(each), "secret-owners")
    told = each.join(owners, "hash").withColumn("is_shared", (F.col("n_owners") >= shared) | (F.col("n_repos") >= shared_repos)).withColumn("is_live", F.col("live") & ~F.col("is_shared"))
    span = F.struct(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end"), "is_shared")
    value = F.struct(F.col("values").alias("start"), F.lit(3).alias("kind"), F.col("ends").alias("end"), "is_shared")
    both = F.concat(F.array(span), F.when(F.col("is_live"), F.array(value)).otherwise(F.slice(F.array(value), 1, 0)))
    grouped = told.select("row", F.explode(both).alias("span"), "is_live", "n_owners", "n_repos").groupBy("row")
    return grouped.agg(F.array_sort(F.collect_set("span")).alias("spans"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))


def _key():
    """128 bits of id, source and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\x00", part("doc_id"), part("source"), part("text"))))


def digests(docs: DataFrame) -> DataFrame:
    """Documents with doc_id, text and source -> counts by kind, a digest of the base spans, all spans, and what is shared or live."""
    numbered = docs.select("doc_id", "source", "text").withColumn("row", _key())
    spans = scanned(numbered)
    # Rows of equal id, source and text are the same row here and have the same spans.
    ids = written(numbered.select("doc_id", "row"), "secret-rows")
    out = ids.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,is_shared:boolean>>)")))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return out.select(
        "doc_id", *(number(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter(base, lambda s: s["is_shared"])).cast("long").alias("n_shared"), F.coalesce("most_owners", F.lit(0)).alias("most_owners"), F.coalesce("most_repos", F.lit(0)).alias("most_repos"),
    )


def masked(docs: DataFrame, shared: int = SHARED_OWNERS) -> DataFrame:
    """All documents with all columns; secrets are masked in text, and n_chars follows where there is one. Widely copied examples stay."""
    names = docs.columns
    # The text itself says which row it is; copies of a row are masked alike.
    keyed = docs.select(_key().alias("key"), F.struct(*names).alias("row"))
    spans = scanned(docs.select("doc_id", "source", "text", _key().alias("row")), shared=shared)
    spans = spans.select(F.col("row").alias("key"), F.filter("spans", lambda s: ~s["is_shared"]).alias("spans")).filter(F.size("spans") > 0)
    spans = written(spans.select("key", F.col("spans.start").alias("start"), F.col("spans.end").alias("end")), "secret-masks")

    @F.pandas_udf("string")
    def without(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, start, end, strict=True):
            at, parts = 0, []
            for x, y in sorted(zip(a, b, strict=True)):
                if y > at:
                    parts += [t[at : max(x, at)], MASK if x >= at else ""]
                    at = y
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    n_rows, n_spans = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("start")), F.lit(0))).first()
    few = 100 * n_rows + 8 * n_spans <= SENT_BYTES
    hit = keyed.join(F.broadcast(spans) if few else spans, "key", "left")
    rest = hit.filter("start is null").select("row")
    hit = hit.filter("start is not null").select(F.col("row").withField("text", without("row.text", "start", "end")).alias("row"))
    if "n_chars" in names:
        hit = hit.select(F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return rest.unionByName(hit).select("row.*")
