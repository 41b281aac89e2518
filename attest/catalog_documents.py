"""Queries over whole documents, with their SQL: verification against documents, extraction from them, chat."""

from pyspark.sql import functions as F

from attest import vocabulary as V
from attest.catalog import _RULES, _TOP, _chunks, _list, _table, query
from attest.fixtures import frame, sql
from attest.operators import documents as D
from attest.operators import retrieval as R
from attest.operators._store import saved
from attest.plans.verification import verify_claims as verify

# --- claims against documents ---

#: Every benchmark item as a claim in every corpus, and a judge's reply for most of them.
_SAID = """
  select query_id * 4 + corpus_id as claim_id, corpus_id, split_part(query_text, ' ', 1) as subject,
         concat(case cast(query_id % 4 as int) when 0 then 'reportedly ' when 1 then 'always ' else '' end, query_text) as claim_text,
         cast(null as {text}) as predicate, cast(null as {text}) as object_text
  from ({queries}) q"""
_JUDGED = """
  select claim_id, case cast(claim_id % 4 as int) when 0 then 'SUPPORTED' when 1 then 'CONTRADICTED' when 2 then 'EXAGGERATED' else 'SUPPORTED' end as judge_verdict,
         case when claim_id % 9 = 0 then null else cast(claim_id % 11 as double) / 10.0 end as score
  from ({said}) s where claim_id % 7 <> 0"""


def _said(dialect: str) -> str:
    return _SAID.format(queries=sql("queries", dialect), text="string" if dialect == "spark" else "varchar")


_VERIFIED = (
    f"with claims as ({_said('duckdb')}), judge as ({_JUDGED.format(said=_said('duckdb'))}), docs as ({sql('docs', 'duckdb')}), "
    "queries as (select claim_id as query_id, corpus_id, concat_ws(' ', nullif(trim(subject), ''), nullif(trim(claim_text), '')) as query_text from claims)"
    + _TOP
    + f""", ruled as ({_RULES}),
    b as (select corpus_id, query_id, arg_min(chunk_id, rank) as best_chunk, count(*) as n_passages from top group by corpus_id, query_id),
    x as (select r.claim_id, r.corpus_id, r.penalty, b.best_chunk, coalesce(b.n_passages, 0) as n_passages, j.judge_verdict, case when b.n_passages is not null then j.score end as score
          from ruled r left join b on b.query_id = r.claim_id and b.corpus_id = r.corpus_id left join judge j on j.claim_id = r.claim_id),
    v as (select *, case when n_passages = 0 then 'SOURCE_MISSING' when judge_verdict is null then 'INSUFFICIENT_EVIDENCE'
                         when judge_verdict = 'SUPPORTED' and penalty >= 0.1 and (score is null or score < 0.6) then 'EXAGGERATED' else judge_verdict end as verdict from x)
    select claim_id, corpus_id, best_chunk, n_passages, verdict, case when score is not null then floor(score * (1 - penalty) * 1000 + 0.5) / 1000 end as fused,
           case when n_passages = 0 or verdict in ('CONTRADICTED', 'EXAGGERATED', 'SOURCE_MISSING') then 'CONTESTED' else 'MACHINE_ONLY' end as state from v"""
)


@query(_VERIFIED)
def verify_claims(spark, sf_dir):
    """Claims with the best passages among all documents of their corpus, to verdicts."""
    frame(spark, sf_dir, "queries")  # registers the views
    claims = spark.sql(_said("spark"))
    judge = spark.sql(_JUDGED.format(said=_said("spark")))
    return verify(claims, _chunks(spark, sf_dir), judge).select("claim_id", "corpus_id", "best_chunk", "n_passages", "verdict", "fused", "state")


# --- facts and claims of documents ---

_SPOKEN = "select doc_id as chunk_id, concat(text, case when doc_id % 3 = 0 then concat(' Region ', source, ' supplies ', lang, ' readers.') else '' end) as content from documents where text is not null"


@query(f"""
with chunks as ({_SPOKEN}),
cut as (select chunk_id, unnest(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) as no from chunks),
said as (select chunk_id, no, trim(s) as sentence from cut where length(trim(s)) > 15),
w as (select *, string_split_regex(sentence, '\\s+') as words, list_transform(string_split_regex(sentence, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z_]', '', 'g')) as plain from said),
p as (select *, list_min(list_filter(range(2, len(words)), lambda i: plain[i] in {_list([p[0] for p in V.PREDICATES])})) as place from w),
o as (select *, plain[place] as predicate, array_to_string(words[:place - 1], ' ') as subject, array_to_string(words[place + 1:], ' ') as after from p),
f as (select *, case when position('.' in after) > 1 then split_part(after, '.', 1) else after end as object from o),
i as (select *, coalesce(place is not null and trim(object) <> '', false) as is_fact from f),
n as (select *, sum(is_fact::int) over (partition by chunk_id order by no) as nth from i),
open as (select * from n where nth - is_fact::int < 8),
c as (select *, row_number() over (partition by chunk_id order by no) as k from open where length(sentence) > 25)
select chunk_id, 'TRIPLE' as kind, subject, predicate, object as object_or_claim, sentence from open where is_fact
union all select chunk_id, 'CLAIM', words[1], 'NEUTRAL', sentence, sentence from c where k <= 8""")
def extract_spo(spark, sf_dir):
    """Facts and claims of all documents; a third of them end with a sentence that states a fact."""
    _table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return D.extract_spo(spark.sql(_SPOKEN))


# --- chat ---


def _asked(spark, sf_dir):
    """Every benchmark item as a question in every corpus, nation names, which facts have, and customers' in a corpus that knows none."""
    q = frame(spark, sf_dir, "queries").select("corpus_id", F.col("query_id").alias("question_id"), F.col("query_text").alias("question"))
    n = _table(spark, sf_dir, "nation").select(F.lit(1).cast("long").alias("corpus_id"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("question_id"), F.col("n_name").alias("question"))
    c = _table(spark, sf_dir, "customer").select(F.lit(2).cast("long").alias("corpus_id"), (F.col("c_custkey") + 2_000_000).cast("long").alias("question_id"), F.col("c_name").alias("question"))
    return q.unionByName(n).unionByName(c)


_QUESTIONS = f"(select corpus_id, query_id as question_id, query_text as question from ({sql('queries', 'duckdb')}) q union all select 1, n_nationkey + 1000000, n_name from nation union all select 2, c_custkey + 2000000, c_name from customer)"
_ASKED_TRIPLES = f"select distinct q.corpus_id, q.question_id from {_QUESTIONS} q join triples t on t.corpus_id = q.corpus_id and t.status = 'APPROVED' and (contains(lower(t.subject_text), lower(trim(q.question))) or contains(lower(t.object_text), lower(trim(q.question)))) where trim(q.question) <> ''"


@query(
    f"with triples as ({sql('triples', 'duckdb')}), docs as ({sql('docs', 'duckdb')}), queries as (select corpus_id, question_id as query_id, question as query_text from {_QUESTIONS} z)"
    + _TOP
    + f", told as ({_ASKED_TRIPLES}) select corpus_id, question_id from {_QUESTIONS} q where not exists (select 1 from top where top.corpus_id = q.corpus_id and top.query_id = q.question_id) and not exists (select 1 from told where told.corpus_id = q.corpus_id and told.question_id = q.question_id)"
)
def chat_refused(spark, sf_dir):
    """Questions for which neither a passage nor a fact is found."""
    asked = saved(_asked(spark, sf_dir).repartition("corpus_id", "question_id"), "questions")  # customers may lie in one row group
    passages = R.retrieve_any(asked.select("corpus_id", F.col("question_id").alias("query_id"), F.col("question").alias("query_text")), _chunks(spark, sf_dir)).withColumnRenamed("query_id", "question_id")
    return R.chat_refused(asked, passages, R.chat_names(asked, frame(spark, sf_dir, "triples")))
