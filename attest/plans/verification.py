"""Claims to verdicts, set at a time: wording rules, retrieval, evidence, the judge's replies, fusion."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions import scores as S
from attest.functions import text as T
from attest.operators import claims as C
from attest.operators import retrieval as R


def verify_claims(claims: DataFrame, chunks: DataFrame, judge: DataFrame, k: int = 5) -> DataFrame:
    """Approved claims -> a verdict row each: penalty, best passage, evidence, verdict, fused score, state.

    judge: claim_id, judge_verdict, score; a claim without a reply has insufficient evidence. Replies
    count only where passages were found.
    """
    ruled = C.claim_rules(claims)
    q = T.evidence_query(F.col("subject"), F.col("claim_text"), F.col("predicate"), F.col("object_text"))
    queries = ruled.select("corpus_id", F.col("claim_id").alias("query_id"), q.alias("query_text"))
    found = R.retrieve_topk(queries, chunks, k)
    best = found.groupBy("corpus_id", F.col("query_id").alias("claim_id")).agg(F.min_by("chunk_id", "rank").alias("best_chunk"), F.count("*").alias("n_passages"))
    rows = ruled.join(best, ["corpus_id", "claim_id"], "left").join(judge.select("claim_id", "judge_verdict", "score"), "claim_id", "left")
    evidence = F.when(F.col("n_passages").isNull(), "NO_EVIDENCE").otherwise("EVIDENCE_FOUND")
    score = F.when(evidence == "EVIDENCE_FOUND", F.col("score"))
    rows = rows.withColumns({"evidence": evidence, "score": score, "n_passages": F.coalesce("n_passages", F.lit(0))})
    return C.settle(rows).withColumn("state", S.initial_state(F.col("verdict"), F.col("evidence")))
