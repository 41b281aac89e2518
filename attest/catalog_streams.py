"""Streams over the given tables, run to their end, with the SQL of their batch twins; and the sources and sinks that they use.

A watermark is the latest time of the table less the lateness, so what a stream has put out by its end can be said in SQL.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.catalog import _dealt, _table, query
from attest.catalog_views import _DEALT, _replies
from attest.operators import views as W
from attest.operators._store import shared_folder
from attest.sources import readers, sinks
from attest.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_MARK = "(select max(ts) from events)"


@query("select user_id, event_id, nth, nth <= 3 as allowed, greatest(0, 3 - nth) as remaining from (select user_id, event_id, row_number() over (partition by user_id, session order by ts, event_id) as nth from (select *, sum(new) over (partition by user_id order by ts, event_id) as session from (select *, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 86400 * 1000000::bigint, true) then 1 else 0 end as new from events) x) y) z")
def stream_rate_limit(spark, sf_dir):
    """Every call with its number in the caller's session, as it comes."""
    return jobs.run_to_end(jobs.rate_limit(_events(spark, sf_dir), 3, 86400), "rate")


@query("select distinct doc_id % 4 as corpus_id, sha256(text) as content_hash from documents where text is not null and not exists (select 1 from documents s where s.doc_id % 10 = 0 and s.doc_id % 4 = documents.doc_id % 4 and s.text = documents.text)")
def stream_doc_dedup(spark, sf_dir):
    """Texts that were not stored before (every tenth document was), each once."""
    corpus = (F.col("doc_id") % 4).alias("corpus_id")
    stored = _table(spark, sf_dir, "documents").filter("doc_id % 10 = 0 and text is not null").select(corpus, F.sha2("text", 256).alias("content_hash"))
    docs = jobs.table_stream(spark, f"{sf_dir}/documents.parquet").filter("text is not null").select(corpus, "text", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return jobs.run_to_end(jobs.doc_dedup(docs, stored), "dedup").select("corpus_id", "content_hash")


@query(f"select user_id as run_id, min(ts) as start, count(*) as processed, count(*) filter (event_type = 'purchase') as triples, count(*) filter (event_type = 'view') as claims, count(*) filter (event_type = 'error') as quarantined from (select *, sum(new) over (partition by user_id order by ts) as session from (select *, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) > 6 * 3600 * 1000000::bigint, true) then 1 else 0 end as new from events) x) y group by user_id, session having max(ts) + interval 6 hours <= date_trunc('millisecond', {_MARK} - interval 10 minutes)")
def stream_run_progress(spark, sf_dir):
    """Totals of the runs that are over by the end of the table."""
    is_ = lambda x: (F.col("event_type") == x).cast("long")
    e = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "ts", F.lit(1).cast("long").alias("processed"), is_("purchase").alias("triples"), is_("view").alias("claims"), is_("error").alias("quarantined"))
    return jobs.run_to_end(jobs.run_progress(e, "6 hours"), "progress").drop("end")


@query(f"select start, event_type as actor_type, count(*) as n, count(*) filter (user_id % 7 = 0) as n_failed from (select *, make_timestamp((epoch_us(ts) // 1800000000 - k) * 1800000000) as start from events, (select 0 as k union all select 1) z) x group by start, event_type having start + interval 60 minutes <= date_trunc('millisecond', {_MARK} - interval 10 minutes)")
def stream_trace_stats(spark, sf_dir):
    """Counts over hours that begin every half hour, those that are over by the end of the table."""
    steps = _events(spark, sf_dir).select("ts", F.col("event_type").alias("actor_type"), F.when(F.col("user_id") % 7 == 0, "FAILED").otherwise("OK").alias("status"))
    return jobs.run_to_end(jobs.trace_stats(steps, "60 minutes", "30 minutes"), "trace").select("start", "actor_type", "n", "n_failed")


@query(f"select user_id as job_id, max(epoch_us(ts)) // 1000 as last_ms from events group by user_id having max(epoch_us(ts)) // 1000 + 15 * 60000 <= epoch_us({_MARK}) // 1000 - 60000")
def stream_job_heartbeat(spark, sf_dir):
    """Jobs that had been silent for a quarter of an hour by the end of the table."""
    return jobs.run_to_end(jobs.job_heartbeat(_events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts")), "heartbeat")


def _debate_events(e: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, ("START", "ARGUED", "WEIGHTS", "DONE", "ABORT")))
    nth = F.when(F.col("event_id") % 40 == 39, 5).otherwise(F.col("event_id") % 4 + 1)
    return e.select((F.col("event_id") % (F.col("user_id") + 20)).alias("debate_id"), "ts", "event_id", F.element_at(names, nth.cast("int")).alias("event"))


@query()
def stream_debate_state(spark, sf_dir):
    """States of debates and the events that they refused, each a row of its kind."""
    return jobs.run_to_end(jobs.debate_state(_debate_events(_events(spark, sf_dir))), "debates")


@query()
def debate_refusals(spark, sf_dir):
    """The same refusals, from the table at once."""
    return W.debate_refusals(_debate_events(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumnRenamed("ts", "at"))


_DECIDED = "(select user_id as triple_id, arg_min(event_type, (ts, event_id)) as decision from events where event_type in ('purchase', 'error') group by user_id)"


@query(
    f"select corpus_id, least(a, b) as low_id, greatest(a, b) as high_id from (select corpus_id, id as a, lead(id) over w as b, lower(trim(o)) as o, lower(trim(lead(o) over w)) as p from (select c_custkey % 4 as corpus_id, c_custkey as id, concat('unit ', c_custkey % 13) as s, c_name as o from customer join {_DECIDED} d on d.triple_id = c_custkey where decision = 'purchase') t window w as (partition by corpus_id, s order by o, id)) x where b is not null and o <> p"
)
def stream_decisions(spark, sf_dir):
    """Conflicts among facts as decisions approve them; customers report to units, of which each has one."""
    t = _table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).cast("long").alias("corpus_id"), F.col("c_custkey").cast("long").alias("triple_id"), F.concat(F.lit("unit "), (F.col("c_custkey") % 13).cast("string")).alias("subject_text"), F.lit("reports_to").alias("predicate"), F.col("c_name").alias("object_text"), F.lit(None).cast("string").alias("effective_time"), F.lit("PENDING").alias("status"))
    e = _events(spark, sf_dir).filter("event_type in ('purchase', 'error')")
    e = e.select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("item_id"), F.when(F.col("event_type") == "purchase", "APPROVE").otherwise("REJECT").alias("decision"), F.col("ts").alias("decided_at"))
    folder = _folder(spark, "decisions")
    jobs.end_of(jobs.decisions(e, t, f"{folder}/findings", f"{folder}/state"))
    found = sinks.read_committed(spark, f"{folder}/findings")
    return found.select("corpus_id", F.least("left_triple_id", "right_triple_id").alias("low_id"), F.greatest("left_triple_id", "right_triple_id").alias("high_id"))


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """Files of replies of all facts, a line each; every eleventh line is cut short."""
    r = _replies(spark, sf_dir, _dealt(spark, sf_dir)).select("corpus_id", "reply_id", "raw_text")
    line = r.select("reply_id", F.to_json(F.struct("corpus_id", "reply_id", "raw_text")).alias("line"))
    folder = _folder(spark, "reply-lines")
    line.select(F.when(F.col("reply_id") % 11 == 5, F.expr("substring(line, 1, length(line) - 4)")).otherwise(F.col("line")).alias("value")).write.text(folder)
    return folder


@query(f"select case when chunk_id % 11 <> 5 then corpus_id else 0 end as corpus_id, case when chunk_id % 11 <> 5 then chunk_id end as reply_id, chunk_id % 11 = 5 as is_broken from (select distinct corpus_id, chunk_id from {_DEALT} d) x", "facts")
def src_model_replies(spark, sf_dir):
    """Replies from JSON lines, those that can't be read too."""
    rows = readers.model_replies(spark, _lines(spark, sf_dir))
    broken = F.col("broken").isNotNull()
    return rows.select("corpus_id", F.when(~broken, F.col("reply_id")).alias("reply_id"), broken.alias("is_broken"))


@query(f"select case when chunk_id % 11 = 5 then 'UNREADABLE_LINE' when chunk_id % 7 = 3 then 'SCHEMA_VALIDATION_FAILED' when chunk_id % 7 in (1, 2) then 'MALFORMED_JSON' else 'GOOD' end as outcome, count(*) as n, count(distinct chunk_id) as n_replies from (select distinct corpus_id, chunk_id from {_DEALT} d) x group by 1", "facts")
def stream_replies(spark, sf_dir):
    """Replies as they come in files, kept or quarantined with the reason."""
    folder = _folder(spark, "replies")
    jobs.end_of(jobs.replies(readers.model_replies(spark, _lines(spark, sf_dir), stream=True), f"{folder}/good", f"{folder}/bad", f"{folder}/state"))
    good = sinks.read_committed(spark, f"{folder}/good").select(F.lit("GOOD").alias("outcome"), "reply_id")
    bad = sinks.read_committed(spark, f"{folder}/bad").select(F.col("reason").alias("outcome"), "reply_id")
    return good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("reply_id").alias("n_replies"))


@query("select user_id % 50 as k, min(event_id % 3) as part from events where event_id % 3 < 2 group by 1")
def sink_tables(spark, sf_dir):
    """Keys of two batches, each written twice, and of a third that was killed before its commit: readers see each key once."""
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k"), (F.col("event_id") % 3).alias("part"))
    folder = _folder(spark, "sink")
    for part in (0, 1, 0, 1):
        sinks.append_new(e.filter(F.col("part") == part), folder, ["k"], part)
    sinks.stage(e.filter("part = 2"), folder, "2")
    return sinks.read_committed(spark, folder).select("k", "part")

