"""Proposals, approval and facts."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest import vocabulary as V
from attest.functions import text as T

REGISTRY = "predicate string, cardinality string, bounded_max int, symmetric boolean, transitive boolean, mutually_exclusive boolean, temporal boolean"


def registry(spark: SparkSession) -> DataFrame:
    """The 28 registered predicates."""
    return spark.createDataFrame(V.PREDICATES, REGISTRY)


def with_predicate(df: DataFrame) -> DataFrame:
    """Adds what the registry says of a predicate, in any case; unknown ones hold many values and never conflict."""
    table = F.broadcast(registry(df.sparkSession).withColumnRenamed("predicate", "_name"))  # 28 rows
    out = df.join(table, F.lower("predicate") == F.col("_name"), "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("symmetric", "transitive", "mutually_exclusive", "temporal")}
    out = out.withColumns({"known": F.col("_name").isNotNull(), "cardinality": F.coalesce("cardinality", F.lit("MULTI")), "bounded_max": F.coalesce("bounded_max", F.lit(0)), **flags})
    return out.withColumn("holds_one", (F.col("cardinality") == "SINGLE") & F.col("mutually_exclusive")).drop("_name")


def fact_hash(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.sha2(F.concat_ws("|", subject, predicate, obj), 256)


def triple_upsert(proposals: DataFrame) -> DataFrame:
    """One row per (corpus, fact): the first proposal's text, and how many there were. Proposals without an end are dropped."""
    keyed = proposals.withColumns({"subject_key": T.entity_key(F.col("subject_text")), "object_key": T.entity_key(F.col("object_text"))}).filter("subject_key <> '' and object_key <> ''")
    keyed = keyed.withColumn("fact_hash", fact_hash(F.col("subject_key"), F.col("predicate"), F.col("object_key")))
    first = F.min(F.struct("triple_id", "subject_text", "object_text"))
    out = keyed.groupBy("corpus_id", "fact_hash", "predicate").agg(first.alias("first"), F.count("*").alias("evidence_chunk_count"))
    return out.select("corpus_id", "fact_hash", "predicate", "first.*", "evidence_chunk_count")


def claim_dedup(claims: DataFrame) -> DataFrame:
    """The first claim of each (corpus, subject, text, polarity)."""
    keyed = claims.withColumn("claim_hash", F.sha2(F.concat_ws("|", "subject", "claim_text", "polarity"), 256))
    return keyed.groupBy("corpus_id", "claim_hash").agg(F.min("claim_id").alias("claim_id"), F.count("*").alias("n_repeats"))


def approval_apply(decisions: DataFrame) -> DataFrame:
    """A log of decisions -> each one applied (the first of its item) or in conflict with it."""
    order = Window.partitionBy("item_id").orderBy("decided_at", "decision_id")
    return decisions.withColumn("outcome", F.when(F.row_number().over(order) == 1, F.lit("APPLIED")).otherwise(F.lit("CONFLICT")))


def item_states(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with the state that the first decision on them gives."""
    first = decisions.groupBy("item_id").agg(F.min_by("decision", F.struct("decided_at", "decision_id")).alias("decision"), F.count("*").alias("n_decisions"))
    state = F.when(F.col("decision") == "APPROVE", "APPROVED").when(F.col("decision") == "REJECT", "REJECTED").otherwise("PENDING")
    return items.join(first, "item_id", "left").select(*items.columns, state.alias("status"), F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


def bulk_approve(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """How many of the ids were still pending and are approved now, by corpus."""
    asked = triples.join(ids, "triple_id", "left_semi")
    return asked.groupBy("corpus_id").agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "PENDING").alias("approved"), F.count_if(F.col("status") != "PENDING").alias("skipped"))


def approval_queue(triples: DataFrame, most: int = 50) -> DataFrame:
    """The newest pending triples of each corpus."""
    newest = Window.partitionBy("corpus_id").orderBy(F.desc("triple_id"))
    return triples.filter("status = 'PENDING'").withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)


def approval_overview(triples: DataFrame, claims: DataFrame, most: int = 50) -> DataFrame:
    """The newest facts (PENDING) and claims (PROPOSED) of each corpus that wait for a decision, each with how many of its kind wait."""
    t = triples.filter("status = 'PENDING'").select(F.lit("TRIPLE").alias("kind"), "corpus_id", F.col("triple_id").alias("item_id"), F.concat_ws(" ", "subject_text", "predicate", "object_text").alias("text"))
    c = claims.filter("status = 'PROPOSED'").select(F.lit("CLAIM").alias("kind"), "corpus_id", F.col("claim_id").alias("item_id"), F.col("claim_text").alias("text"))
    rows = t.unionByName(c)
    n = rows.groupBy("kind", "corpus_id").agg(F.count("*").alias("n_pending"))
    newest = Window.partitionBy("kind", "corpus_id").orderBy(F.desc("item_id"))
    return rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most).join(n, ["kind", "corpus_id"])


def approved(triples: DataFrame) -> DataFrame:
    return triples.filter("status = 'APPROVED'")


def triples_of_entity(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples that touch one of the named entities, as subject or object, each once: two equi joins instead of an OR."""
    a = triples.join(names.withColumnRenamed("name", "subject_text"), "subject_text", "left_semi")
    b = triples.join(names.withColumnRenamed("name", "object_text"), "object_text", "left_semi")
    return a.unionByName(b).dropDuplicates(["triple_id"])


def predicate_coverage(triples: DataFrame) -> DataFrame:
    """Which predicates are registered, used, or both."""
    used = triples.groupBy(F.lower("predicate").alias("predicate")).agg(F.count("*").alias("n"))
    both = used.join(registry(triples.sparkSession).select("predicate", F.lit(True).alias("registered")), "predicate", "full_outer")
    state = F.when(F.col("n").isNull(), "NEVER_USED").when(F.col("registered").isNull(), "UNREGISTERED").otherwise("USED")
    return both.select("predicate", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def bad_rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; a rule whose value is null is kept, as in SQL checks."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.select(F.col(key).alias("row_key"), F.explode(broken).alias("rule"))


def orphans(df: DataFrame, column: str, parents: DataFrame, parent: str, rule: str) -> DataFrame:
    """Rows whose reference has no target."""
    lost = df.filter(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti")
    return lost.select(F.col(column).alias("row_key"), F.lit(rule).alias("rule"))


def repeats(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that should be unique but are not."""
    return df.groupBy(*keys).count().filter("count > 1").select(F.col(keys[0]).alias("row_key"), F.lit(rule).alias("rule"))
