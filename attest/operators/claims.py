"""Claims: wording rules, verdicts and their history."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import scores as S


def _hits(claims: DataFrame, text: str) -> DataFrame:
    """Adds the hits of each kind. Plain text, tokens and hits are columns of their own steps, so each is made once."""
    rows = claims.withColumn("_plain", S.claim_plain(F.col(text))).withColumn("_t", S.claim_tokens(F.col("_plain")))
    return rows.withColumns({"_weasels": S.weasel_hits(F.col("_t")), "_absolutes": S.absolute_hits(F.col("_t")), "_phrases": S.phrase_hits(F.col("_plain"))})


def claim_rules(claims: DataFrame, text: str = "claim_text") -> DataFrame:
    """Adds how many hedging and overstating terms a claim has, and its penalty. Blank text has none."""
    out = _hits(claims, text).select(*claims.columns, F.size("_weasels").alias("weasels"), (F.size("_absolutes") + F.size("_phrases")).alias("absolutes"))
    return out.withColumn("penalty", S.rule_penalty(F.col("weasels"), F.col("absolutes")))


def claim_rule_hits(claims: DataFrame, text: str = "claim_text") -> DataFrame:
    """One row per hit: category, term and place (-1 for phrases)."""
    def named(kind):
        return lambda x: F.struct(F.lit(kind).alias("category"), x["term"].alias("term"), x["place"].alias("place"))

    kinds = {"WEASEL": "_weasels", "ABSOLUTE": "_absolutes", "ABSOLUTE_PHRASE": "_phrases"}
    hits = F.concat(*(F.transform(c, named(k)) for k, c in kinds.items()))
    return _hits(claims, text).select("claim_id", F.explode(hits).alias("hit")).select("claim_id", "hit.*")


def claim_rule_explain(claims: DataFrame, text: str = "claim_text") -> DataFrame:
    terms = lambda a: F.transform(a, lambda x: x["term"])
    parts = _hits(claims, text).select("claim_id", terms("_weasels").alias("w"), F.concat(terms("_absolutes"), terms("_phrases")).alias("a"))
    return parts.select("claim_id", S.rule_explanation(F.col("w"), F.col("a"), S.rule_penalty(F.size("w"), F.size("a"))).alias("explanation"))


def settle(claims: DataFrame) -> DataFrame:
    """Rows with judge_verdict, evidence, penalty and score -> verdict, fused score and whether people must look."""
    v = S.resolve_verdict(F.col("judge_verdict"), F.col("evidence"), F.col("penalty"), F.col("score"))
    out = claims.withColumns({"verdict": v, "fused": S.fuse_score(F.col("score"), F.col("penalty"))})
    return out.withColumn("state", S.initial_state(F.col("verdict"), F.col("evidence")))


def verdicts(claims: DataFrame, judge: DataFrame, text: str = "claim_text") -> DataFrame:
    """Claims with the judge's reply and what ``settle`` makes the verdict. Only the text of claims whose verdict hangs on their wording is read.

    judge: claim_id, judge_verdict, evidence and score.
    """
    rows = claims.join(judge.hint("shuffle_hash"), "claim_id")
    worded = S.resolve_verdict(F.col("judge_verdict"), F.col("evidence"), F.lit(1.0), F.col("score")) != S.resolve_verdict(F.col("judge_verdict"), F.col("evidence"), F.lit(0.0), F.col("score"))
    ruled = claim_rules(rows.withColumn("_read", F.when(worded, F.col(text))), "_read")
    return ruled.withColumn("verdict", S.resolve_verdict(F.col("judge_verdict"), F.col("evidence"), F.col("penalty"), F.col("score"))).drop("_read", "weasels", "absolutes", "penalty")


def verdict_evidence(passages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages of the verdict's own corpus, and those refused as from another."""
    both = passages.join(chunks.select("chunk_id", F.col("corpus_id").alias("chunk_corpus")), "chunk_id")
    own = F.col("corpus_id") == F.col("chunk_corpus")
    return both.filter(own).drop("chunk_corpus"), both.filter(~own).withColumn("reason", F.lit("CROSS_CORPUS_ATTEMPT_BLOCKED"))


def verdict_supersede(verdicts: DataFrame) -> DataFrame:
    """A log of verdicts -> each with whether it is current and, if not, when the next one took its place."""
    order = Window.partitionBy("claim_id").orderBy("created_at", "verdict_id")
    after = F.lead("created_at").over(order)
    return verdicts.withColumns({"superseded_at": after, "is_current": F.lead("verdict_id").over(order).isNull()})


def verdict_adjudicate(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """The first human verdict counts; the machine's is kept beside it."""
    first = decisions.groupBy("claim_id").agg(F.min_by("human_verdict", F.struct("decided_at", "decision_id")).alias("human_verdict"), (F.count("*") - 1).alias("n_refused"))
    out = verdicts.join(first, "claim_id", "left")
    return out.select(*verdicts.columns, "human_verdict", F.coalesce("human_verdict", "verdict").alias("effective"), F.coalesce(F.col("human_verdict") != F.col("verdict"), F.lit(False)).alias("overridden"), F.coalesce("n_refused", F.lit(0)).alias("n_refused"))
