"""Quality of retrieval, extraction and verdicts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import text as T
from attest.operators._store import saved
from attest.operators.ranks import numbered


def _canonical(c):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def run_key(gold: DataFrame) -> DataFrame:
    """(corpus_id, query_text, gold_chunk_id) -> one key per corpus that order, spacing and case don't change."""
    line = F.concat_ws("\t", _canonical(F.col("query_text")), F.col("gold_chunk_id").cast("string"))
    return gold.groupBy("corpus_id").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("run_key"))


def retrieval_rows(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per gold query: the rank of its chunk among those found, hits at 1, 3, 5, and the reciprocal rank."""
    at = found.select("corpus_id", "query_id", F.col("chunk_id").alias("gold_chunk_id"), "rank", "score")
    rows = gold.filter("gold_chunk_id is not null").join(at, ["corpus_id", "query_id", "gold_chunk_id"], "left")
    hit = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    return rows.select("corpus_id", "query_id", "gold_chunk_id", "rank", F.round("score", 4).alias("score"), hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"), F.round(1 / F.col("rank"), 5).alias("rr"))


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """Recall at 1, 3, 5 over all gold rows; the mean reciprocal rank over those that were found."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias(c.replace("hit", "recall_at_"))
    return rows.groupBy("corpus_id").agg(F.count("*").alias("n"), share("hit1"), share("hit3"), share("hit5"), F.round(F.avg("rr"), 6).alias("mrr"), F.count_if(F.col("rank").isNull()).alias("n_not_retrieved"))


def newest_run(rows: DataFrame) -> DataFrame:
    """Of each corpus the rows of the run that was written last: the one that has the greatest row_id."""
    last = rows.groupBy("corpus_id").agg(F.max_by("run_key", "row_id").alias("run_key"))
    return rows.join(last, ["corpus_id", "run_key"], "left_semi")


def retrieval_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to each query's rank between two runs."""
    a = before.select("corpus_id", "query_id", F.col("rank").alias("rank_before"))
    b = after.select("corpus_id", "query_id", F.col("rank").alias("rank_after"))
    both = a.join(b, ["corpus_id", "query_id"], "full_outer")
    x, y = F.coalesce("rank_before", F.lit(1 << 30)), F.coalesce("rank_after", F.lit(1 << 30))
    return both.withColumn("change", F.when(y < x, "BETTER").when(y > x, "WORSE").otherwise("SAME"))


def replace_run(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of all runs but the new one's, and the new ones."""
    return stored.join(new.select("run_key").distinct(), "run_key", "left_anti").unionByName(new)


def _ratios(df: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return df.withColumns({"p": p, "r": r}).withColumn("f1", F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))).select(*df.columns, F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f1", 4).alias("f1"))


def extraction_prf(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """(chunk, subject, predicate, object) sets, compared by normalised labels in their chunk and summed by some of the chunk's columns."""
    key = lambda df, flag: df.select(*by, "chunk_id", T.norm_label(F.col("subject")).alias("s"), T.norm_label(F.col("predicate")).alias("p"), T.norm_label(F.col("object")).alias("o"), F.lit(1).alias(flag)).distinct()
    both = key(gold, "g").join(key(predicted, "h"), [*by, "chunk_id", "s", "p", "o"], "full_outer")
    counts = both.groupBy(*by).agg(F.count_if(F.col("g").isNotNull() & F.col("h").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("h").isNull()).alias("fn"))
    return _ratios(counts)


def place_gold(gold: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sentence, ...) on the first chunk of its document that has the sentence; and gold that no chunk has.

    Chunks overlap, so a sentence may be in several: it is claimed once. A chunk has a sentence if the sentence's words
    are a run of its words. So a chunk's runs, of the lengths that its document's sentences have, are looked up by
    equality: the work grows with the words, not with sentences x chunks of a document. Only runs that begin and end as
    some sentence of the document does are made: 64 bits a document tell of beginnings, 64 of both ends.
    """
    bit = lambda *words: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(*words), F.lit(64)).cast("int"))
    asked = gold.filter("sentence is not null").select("doc_id", F.split(T.norm_label(F.col("sentence")), " ").alias("w")).withColumn("n", F.size("w"))
    shapes = asked.groupBy("doc_id", "n").agg(F.bit_or(bit(F.get("w", F.lit(0)))).alias("begins"), F.bit_or(bit(F.get("w", F.lit(0)), F.get("w", F.col("n") - 1))).alias("ends"))
    shapes = shapes.groupBy("doc_id").agg(F.collect_list(F.struct("n", "ends")).alias("shapes"), F.bit_or("begins").alias("begins"))

    def runs(w):
        begin = lambda i: F.col("begins").bitwiseAND(bit(F.get(w, i))) != 0
        end = lambda x, i: (i <= F.size(w) - x["n"]) & (x["ends"].bitwiseAND(bit(F.get(w, i), F.get(w, i + x["n"] - 1))) != 0)
        of = lambda at: F.transform("shapes", lambda x: F.transform(F.filter(at, lambda i: end(x, i)), lambda i: F.array_join(F.slice(w, i + 1, x["n"]), " ")))
        return F.array_distinct(F.flatten(T.once(F.filter(F.sequence(F.lit(0), F.size(w) - 1), begin), of)))

    # Words are made before the join, in a step of their own, as a lambda would make them anew at each use.
    held = chunks.filter("content is not null").select("doc_id", "chunk_index", T.norm_label(F.col("content")).alias("content")).join(shapes.hint("shuffle_hash"), "doc_id")
    held = held.select("doc_id", "chunk_index", F.explode(T.once(F.split("content", " "), runs)).alias("_run"))
    first = held.groupBy("doc_id", "_run").agg(F.min("chunk_index").alias("chunk_index"))
    run = F.when(F.col("sentence").isNotNull(), T.norm_label(F.col("sentence")))
    at = saved(gold.withColumn("_run", run).join(first.hint("shuffle_hash"), ["doc_id", "_run"], "left").drop("_run"), "placed")
    return at.filter("chunk_index is not null"), at.filter("chunk_index is null").drop("chunk_index")


def extraction_report(gold: DataFrame, predicted: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """Extraction held against gold facts: tp, fp, fn, precision, recall and F1, gold without a place, and the rates of bad chunks.

    gold: doc_id, subject, predicate, object, sentence, each claimed by the first chunk of its document that has the
    sentence. chunks: doc_id, chunk_index, content, outcome (OK, MALFORMED, QUARANTINED or FAILED) and the columns of by.
    predicted: doc_id, chunk_index, subject, predicate, object. All gold of a chunk that is not OK is missed, and
    nothing predicted there counts.
    """
    keys = ["doc_id", "chunk_index"]
    placed, lost = place_gold(gold, chunks)
    # Labels of gold and predictions are dealt by chunk once, and compared there.
    label = lambda df, gold: df.select(*keys, T.norm_label(F.col("subject")).alias("s"), T.norm_label(F.col("predicate")).alias("p"), T.norm_label(F.col("object")).alias("o"), F.lit(gold).alias("g"))
    both = label(placed, True).unionByName(label(predicted, False)).repartition(*keys).groupBy(*keys, "s", "p", "o").agg(F.bool_or("g").alias("g"), F.bool_or(~F.col("g")).alias("h"))
    per = both.groupBy(*keys).agg(F.count_if("g").alias("n_gold"), F.count_if("h").alias("n_said"), F.count_if(F.col("g") & F.col("h")).alias("n_both"))
    fine = F.max(F.col("outcome") == "OK").over(Window.partitionBy(*keys))
    tp = F.when(F.col("fine"), F.col("n_both")).otherwise(0)
    held = chunks.select(*by, *keys, "outcome", fine.alias("fine")).join(per, keys, "left").withColumns({"tp": tp, "fp": F.when(F.col("fine"), F.col("n_said")).otherwise(0) - tp, "fn": F.col("n_gold") - tp})
    of = lambda x: F.count_if(F.col("outcome") == x)
    n = F.count("*")
    rows = held.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), n.alias("n_chunks"), of("FAILED").alias("n_failed"), F.round(of("MALFORMED") / n, 4).alias("malformed_rate"), F.round(of("QUARANTINED") / n, 4).alias("quarantine_rate"))
    unplaced = lost.join(chunks.select("doc_id", *by).distinct(), "doc_id").groupBy(*by).agg(F.count("*").alias("n_unplaced"))
    return _ratios(rows.join(unplaced, by, "left").fillna(0, ["n_unplaced"]))


def prose_prf(gold: DataFrame, predicted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Precision, recall and F1 of extracted triples and claims against gold ones, by kind.

    gold: doc_id, kind (TRIPLE or CLAIM), subject, predicate, object, polarity (what a kind lacks is null). predicted: the
    same with chunk_index and sentence. chunks: doc_id, chunk_index, content. A gold item belongs to the first chunk of its
    document that has its subject; one without such a chunk is unplaced: an error, and counted in no other column. Items of
    a chunk are equal if their normalised labels are, and for claims the polarity; n_same counts those equal but for that.
    A prediction whose sentence its chunk doesn't have is ungrounded.
    """
    spaced = lambda c: F.concat(F.lit(" "), T.norm_label(F.col(c)), F.lit(" "))
    label = lambda c: T.norm_label(F.coalesce(F.col(c), F.lit("")))
    keys = ["doc_id", "chunk_index", "kind", "s", "p", "o"]
    labelled = lambda df, gold: df.select("doc_id", "chunk_index", "kind", label("subject").alias("s"), label("predicate").alias("p"), label("object").alias("o"), F.coalesce("polarity", F.lit("")).alias("polarity"), F.lit(gold).alias("gold"))
    hit = gold.select("doc_id", "subject").distinct().join(chunks, "doc_id").filter(F.contains(spaced("content"), spaced("subject")))
    first = hit.groupBy("doc_id", "subject").agg(F.min("chunk_index").alias("chunk_index"))
    placed = saved(gold.join(first, ["doc_id", "subject"], "left"), "placed-gold")
    # One group for each label: its polarities among the gold and among the predictions.
    of = lambda flag: F.collect_set(F.when(F.col("gold") == flag, F.col("polarity")))
    both = labelled(placed.filter("chunk_index is not null"), True).unionByName(labelled(predicted, False)).groupBy(*keys).agg(of(True).alias("g"), of(False).alias("h"))
    n = lambda c: F.sum(F.size(c).cast("long"))
    counts = both.groupBy("kind").agg(n(F.array_intersect("g", "h")).alias("tp"), n(F.array_except("h", "g")).alias("fp"), n(F.array_except("g", "h")).alias("fn"), F.count_if((F.size("g") > 0) & (F.size("h") > 0)).alias("n_same"))
    unplaced = placed.filter("chunk_index is null").groupBy("kind").agg(F.count("*").alias("n_unplaced"))
    grounded = F.coalesce(F.contains("content", F.col("sentence")), F.lit(False))
    said = predicted.join(chunks, ["doc_id", "chunk_index"], "left").groupBy("kind").agg(F.count_if(~grounded).alias("n_ungrounded"), F.round(F.count_if(~grounded) / F.count("*"), 4).alias("ungrounded_rate"))
    for other in (unplaced, said):
        counts = counts.join(other, "kind", "full_outer")
    return _ratios(counts.fillna(0))


def label_totals(df: DataFrame) -> DataFrame:
    """Rows with tp, fp, fn -> expected, predicted, correct, missed, incorrect."""
    return df.withColumns({"expected": F.col("tp") + F.col("fn"), "predicted": F.col("tp") + F.col("fp"), "correct": F.col("tp"), "missed": F.col("fn"), "incorrect": F.col("fp")})


def _claim_text(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"\.+$", ""), r"\s+", " "))


def verdict_accuracy(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """Gold (text, expected, category) against claims (claim_text, status, verdict): accuracy by category and overall (null).

    A gold text that no claim has, several have, or whose claim isn't approved is skipped.
    """
    keyed = claims.select(_claim_text(F.col("claim_text")).alias("k"), "status", "verdict").groupBy("k").agg(F.count("*").alias("n"), F.min("status").alias("status"), F.min("verdict").alias("verdict"))
    rows = gold.withColumn("k", _claim_text(F.col("text"))).join(keyed, "k", "left")
    why = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("status") != "APPROVED", "NOT_APPROVED")
    rows = rows.withColumn("why", why)
    used, right = F.count_if(F.col("why").isNull()), F.count_if(F.col("why").isNull() & (F.col("verdict") == F.col("expected")))
    out = rows.rollup("category").agg(F.count("*").alias("n_gold"), used.alias("n_used"), right.alias("n_right"), F.count_if(F.col("why") == "NOT_FOUND").alias("n_not_found"), F.count_if(F.col("why") == "AMBIGUOUS").alias("n_ambiguous"), F.count_if(F.col("why") == "NOT_APPROVED").alias("n_not_approved"))
    return out.withColumn("accuracy", F.when(F.col("n_used") > 0, F.round(F.col("n_right") / F.col("n_used"), 4)))


def latency_percentiles(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95 and max by nearest rank: the value at min(n - 1, floor(n p)) in order; a group is not sorted in one task."""
    rows = numbered(samples.select(*by, F.col(value).alias("v")), by, ["v"], "i", "n").withColumn("i", F.col("i") - 1)
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    pick = lambda p, name: F.max(F.when(F.col("i") == at(p), F.col("v"))).alias(name)
    return rows.groupBy(*by).agg(F.max("n").alias("n"), pick(0.5, "p50"), pick(0.95, "p95"), F.max("v").alias("top"))
