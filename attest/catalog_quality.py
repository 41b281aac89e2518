"""Queries on the quality of tables and of extraction, and on what reviewers look at, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from attest.catalog import _CLAIM_QUERIES, _NORM_LABEL, _SURFACES, _TOKENS, _chunks, _table, query
from attest.catalog_views import _ROWS
from attest.fixtures import frame
from attest.functions import text as T
from attest.operators._store import saved
from attest.operators import entities as N
from attest.operators import evaluation as E
from attest.operators import facts as K
from attest.operators import retrieval as R
from attest.operators import rules as U
from attest.operators import views as W
from attest.sources import tables as S

# --- rules ---

#: What the derived tables must keep.
RULES = [
    ("triples", "status_known", "among", ("status", ("PENDING", "APPROVED", "REJECTED"))),
    ("triples", "approved_has_decider", "implies", ("status = 'APPROVED'", "decided_by is not null")),
    ("triples", "chunk_exists", "refers", ("source_chunk_id", "documents", "doc_id")),
    ("triples", "one_row_a_fact", "unique", ("corpus_id", "subject_text", "predicate", "object_text")),
    ("verdicts", "missing_means_no_evidence", "both", ("verdict = 'SOURCE_MISSING'", "evidence = 'NO_EVIDENCE'")),
    ("verdicts", "contradicted_has_evidence", "implies", ("verdict = 'CONTRADICTED'", "evidence = 'EVIDENCE_FOUND'")),
    ("verdicts", "score_in_range", "between", ("score", 0.0, 0.9)),
    ("verdicts", "claim_exists", "refers", ("claim_id", "claims", "claim_id")),
    ("chunks", "ends_after_start", "before", ("start_offset", "end_offset")),
    ("citations", "one_target", "one_of", ("chunk_id", "fact_id")),
    ("citations", "argument_exists", "refers", ("argument_id", "arguments", "argument_id")),
    ("weights", "one_to_five", "between", ("weight", 1, 5)),
    ("weights", "argument_exists", "refers", ("argument_id", "arguments", "argument_id")),
    ("weights", "one_weight", "unique", ("weight_id",)),
    ("rounds", "within_ceiling", "check", ("round_number <= most_rounds",)),
    ("rounds", "one_row_a_round", "unique", ("debate_id", "round_number")),
]
_ROW_KEYS = {"triples": "triple_id", "verdicts": "claim_id", "chunks": "doc_id", "citations": "argument_id", "weights": "weight_id", "rounds": "round_id", "documents": "doc_id", "claims": "claim_id", "arguments": "argument_id"}


def _ruled(spark, sf_dir):
    a = frame(spark, sf_dir, "arguments")
    t = frame(spark, sf_dir, "triples").withColumn("decided_by", F.when(F.col("triple_id") % 11 != 0, F.col("triple_id") % 9))
    v = frame(spark, sf_dir, "judge").withColumn("verdict", F.when((F.col("evidence") == "NO_EVIDENCE") & (F.col("claim_id") % 2 == 0), "SOURCE_MISSING").otherwise(F.col("judge_verdict")))
    d = _table(spark, sf_dir, "documents")
    return {
        "triples": t, "verdicts": v, "claims": frame(spark, sf_dir, "claims").filter("claim_id % 50 <> 0"), "documents": d.filter("doc_id % 20 <> 0"), "arguments": a.filter("argument_id % 40 <> 0"),
        "chunks": d.select("doc_id", F.lit(10).alias("start_offset"), F.length("text").alias("end_offset")), "weights": frame(spark, sf_dir, "weights"),
        "citations": a.select("argument_id", F.when(F.col("argument_id") % 3 == 0, F.col("source_id")).alias("chunk_id"), F.when(F.col("argument_id") % 5 != 1, F.col("source_id")).alias("fact_id")),
        "rounds": a.groupBy("round_id", "debate_id", "round_number").agg(F.lit(3).alias("most_rounds")),
    }


@query(
    """, t as (select *, case when triple_id % 11 <> 0 then triple_id % 9 end as decided_by from triples),
    v as (select *, case when evidence = 'NO_EVIDENCE' and claim_id % 2 = 0 then 'SOURCE_MISSING' else judge_verdict end as verdict from judge),
    r as (select distinct round_id, debate_id, round_number from arguments)
    select 'triples' as table_name, 'status_known' as rule, count(*) filter (status not in ('PENDING', 'APPROVED', 'REJECTED')) as n_broken from t
    union all select 'triples', 'approved_has_decider', count(*) filter (status = 'APPROVED' and decided_by is null) from t
    union all select 'triples', 'chunk_exists', count(*) filter (source_chunk_id not in (select doc_id from documents where doc_id % 20 <> 0)) from t
    union all select 'triples', 'one_row_a_fact', count(*) from (select 1 from t group by corpus_id, subject_text, predicate, object_text having count(*) > 1) x
    union all select 'verdicts', 'missing_means_no_evidence', count(*) filter ((verdict = 'SOURCE_MISSING') <> (evidence = 'NO_EVIDENCE')) from v
    union all select 'verdicts', 'contradicted_has_evidence', count(*) filter (verdict = 'CONTRADICTED' and evidence <> 'EVIDENCE_FOUND') from v
    union all select 'verdicts', 'score_in_range', count(*) filter (score > 0.9) from v
    union all select 'verdicts', 'claim_exists', count(*) filter (claim_id not in (select claim_id from claims where claim_id % 50 <> 0)) from v
    union all select 'chunks', 'ends_after_start', count(*) filter (length(text) <= 10) from documents
    union all select 'citations', 'one_target', count(*) filter ((argument_id % 3 = 0) = (argument_id % 5 <> 1)) from arguments
    union all select 'citations', 'argument_exists', count(*) filter (argument_id % 40 = 0) from arguments
    union all select 'weights', 'one_to_five', count(*) filter (weight not in (1, 2, 3, 4, 5)) from weights
    union all select 'weights', 'argument_exists', count(*) filter (argument_id % 40 = 0) from weights
    union all select 'weights', 'one_weight', count(*) from (select 1 from weights group by weight_id having count(*) > 1) x
    union all select 'rounds', 'within_ceiling', count(*) filter (round_number > 3) from r
    union all select 'rounds', 'one_row_a_round', count(*) from (select 1 from r group by debate_id, round_number having count(*) > 1) x""",
    "triples", "judge", "claims", "arguments", "weights",
)
def constraint_rules(spark, sf_dir):
    """How many rows break each of the declared rules."""
    return U.audit(_ruled(spark, sf_dir), _ROW_KEYS, RULES)


#: Declared columns and keys of some of the given tables.
CONTRACTS = {
    "customer": ("c_custkey bigint not null, c_name string not null, c_nationkey bigint not null", ["c_custkey"]),
    "documents": ("doc_id bigint not null, text string, lang string, source string", ["doc_id"]),
    "events": ("event_id bigint not null, user_id bigint not null, event_type string, value double", ["event_id"]),
    "lineitem": ("l_orderkey bigint not null, l_linenumber bigint not null, l_quantity double", ["l_orderkey", "l_linenumber"]),
    "labels": ("doc_id bigint not null, quality bigint, toxic bigint, reviewer string", ["doc_id"]),
}


@query(
    """select 'labels' as table_name, 'reviewer' as column_name, 'MISSING_COLUMN' as reason, cast(null as bigint) as n
    union all select 'customer', 'c_custkey', 'REPEATED_KEY', count(*) from (select 1 from customer group by c_custkey having count(*) > 1) x
    union all select 'documents', 'doc_id', 'REPEATED_KEY', count(*) from (select 1 from documents group by doc_id having count(*) > 1) x
    union all select 'events', 'event_id', 'REPEATED_KEY', count(*) from (select 1 from events group by event_id having count(*) > 1) x
    union all select 'lineitem', 'l_orderkey,l_linenumber', 'REPEATED_KEY', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) x
    union all select 'labels', 'doc_id', 'REPEATED_KEY', count(*) from (select 1 from labels group by doc_id having count(*) > 1) x
    union all select 'customer', unnest(['c_custkey', 'c_name', 'c_nationkey']), 'NULL_VALUE', unnest([count(*) filter (c_custkey is null), count(*) filter (c_name is null), count(*) filter (c_nationkey is null)]) from customer
    union all select 'documents', 'doc_id', 'NULL_VALUE', count(*) filter (doc_id is null) from documents
    union all select 'events', unnest(['event_id', 'user_id']), 'NULL_VALUE', unnest([count(*) filter (event_id is null), count(*) filter (user_id is null)]) from events
    union all select 'lineitem', unnest(['l_orderkey', 'l_linenumber']), 'NULL_VALUE', unnest([count(*) filter (l_orderkey is null), count(*) filter (l_linenumber is null)]) from lineitem
    union all select 'labels', 'doc_id', 'NULL_VALUE', count(*) filter (doc_id is null) from labels"""
)
def src_tables(spark, sf_dir):
    """The given tables against their contracts: what the files lack, and keys and nulls in the rows."""
    out = None
    for name, (columns, key) in CONTRACTS.items():
        rows, faults = S.table(spark, f"{sf_dir}/{name}.parquet", name, columns)
        # The types of numbers differ between the sizes of the given tables; that is no part of this result.
        own = faults.filter("reason <> 'WRONG_TYPE'").withColumn("n", F.lit(None).cast("long")).unionByName(S.key_faults(rows, name, columns, key))
        out = own if out is None else out.unionByName(own)
    return out


# --- extraction against gold ---

_SPOKEN = """, i as (select *, concat_ws(' ', s, p, o) as sentence, row_number() over (partition by s order by triple_id, p, o) as n, count(*) over (partition by s) as m from facts),
    i2 as (select *, (n - 1) // 8 as chunk_index from i),
    c0 as (select s, chunk_index, sentence, triple_id, true as own from i2 union all select s, chunk_index + 1, sentence, triple_id, false from i2 where n % 8 = 0 and n < m),
    c as (select s, chunk_index, min(triple_id) filter (own) % 13 as k, string_agg(sentence, '. ') as content from c0 group by s, chunk_index)"""


@query(
    _SPOKEN
    + f""", gold as (select s, chunk_index, p, o, case when triple_id % 29 = 0 then null else sentence end as sentence from i2 where triple_id % 10 < 8),
    f as (select gold.s, sentence, min(c.chunk_index) as chunk_index from (select distinct s, sentence from gold where sentence is not null) gold join c on c.s = gold.s and contains(' ' || {_NORM_LABEL.format('content')} || ' ', ' ' || {_NORM_LABEL.format('sentence')} || ' ') group by 1, 2),
    g as (select distinct gold.s, f.chunk_index, {_NORM_LABEL.format('gold.s')} as a, {_NORM_LABEL.format('p')} as b, {_NORM_LABEL.format('o')} as d from gold join f on f.s = gold.s and f.sentence = gold.sentence),
    h as (select distinct c.s, c.chunk_index, {_NORM_LABEL.format('i2.s')} as a, {_NORM_LABEL.format('p')} as b, {_NORM_LABEL.format("case when triple_id % 17 = 0 then concat(o, ' x') else o end")} as d
          from i2 join c on c.s = i2.s and (c.chunk_index = i2.chunk_index or (i2.n % 8 = 0 and c.chunk_index = i2.chunk_index + 1)) where triple_id % 10 >= 1 and k > 2),
    b as (select coalesce(g.s, h.s) as s, coalesce(g.chunk_index, h.chunk_index) as chunk_index, g.a as ga, h.a as ha from g full join h on g.s = h.s and g.chunk_index = h.chunk_index and g.a = h.a and g.b = h.b and g.d = h.d),
    q as (select s, chunk_index, count(*) filter (ga is not null and ha is not null) as tp, count(*) filter (ga is null) as fp, count(*) filter (ha is null) as fn from b group by 1, 2),
    z as (select length(c.s) % 3 as part, sum(coalesce(tp, 0))::bigint as tp, sum(coalesce(fp, 0))::bigint as fp, sum(coalesce(fn, 0))::bigint as fn, count(*) as n_chunks, count(*) filter (k = 2) as n_failed,
                 round(count(*) filter (k = 0) / count(*), 4) as malformed_rate, round(count(*) filter (k = 1) / count(*), 4) as quarantine_rate from c left join q on q.s = c.s and q.chunk_index = c.chunk_index group by 1),
    u as (select length(s) % 3 as part, count(*) as n_unplaced from gold where sentence is null group by 1)
    select z.*, coalesce(n_unplaced, 0) as n_unplaced, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) as f1
    from z left join u on u.part = z.part""",
    "facts",
)
def extraction_report(spark, sf_dir):
    """Facts as gold and as predictions, in chunks of eight sentences that overlap by one; a quarter of the chunks went wrong."""
    own = Window.partitionBy("s")
    i = frame(spark, sf_dir, "facts").withColumns({"sentence": F.concat_ws(" ", "s", "p", "o"), "n": F.row_number().over(own.orderBy("triple_id", "p", "o")), "m": F.count("*").over(own)})
    i = saved(i.withColumn("chunk_index", F.floor((F.col("n") - 1) / 8)).withColumn("doc_id", F.col("s")), "spoken")
    places = F.when((F.col("n") % 8 == 0) & (F.col("n") < F.col("m")), F.array("chunk_index", F.col("chunk_index") + 1)).otherwise(F.array("chunk_index"))
    said = i.select("doc_id", "sentence", "triple_id", "p", "o", F.col("chunk_index").alias("home"), F.explode(places).alias("chunk_index"))
    k = F.min(F.when(F.col("home") == F.col("chunk_index"), F.col("triple_id"))) % 13
    outcome = F.when(k == 0, "MALFORMED").when(k == 1, "QUARANTINED").when(k == 2, "FAILED").otherwise("OK")
    chunks = saved(said.groupBy("doc_id", "chunk_index").agg(F.array_join(F.array_sort(F.collect_list("sentence")), ". ").alias("content"), outcome.alias("outcome")).withColumn("part", F.length("doc_id") % 3), "spoken-chunks")
    gold = i.filter("triple_id % 10 < 8").select("doc_id", F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.when(F.col("triple_id") % 29 == 0, "never said at all").otherwise(F.col("sentence")).alias("sentence"))
    predicted = said.filter("triple_id % 10 >= 1").select("doc_id", "chunk_index", F.col("doc_id").alias("subject"), F.col("p").alias("predicate"), F.when(F.col("triple_id") % 17 == 0, F.concat("o", F.lit(" x"))).otherwise(F.col("o")).alias("object"))
    return E.extraction_report(gold, predicted, chunks, ["part"])


# --- what reviewers see ---


@query(
    "select 'TRIPLE' as kind, corpus_id, triple_id as item_id, row_number() over (partition by corpus_id order by triple_id desc) as place, count(*) over (partition by corpus_id) as n_pending from triples where status = 'PENDING' qualify place <= 50 union all select 'CLAIM', corpus_id, claim_id, row_number() over (partition by corpus_id order by claim_id desc) as place, count(*) over (partition by corpus_id) from claims where status_no = 4 qualify place <= 50",
    "triples", "claims",
)
def approval_overview(spark, sf_dir):
    """The newest facts and claims that wait for a decision, with how many there are."""
    claims = frame(spark, sf_dir, "claims").withColumn("status", F.when(F.col("status_no") == 4, "PROPOSED").otherwise("APPROVED"))
    return K.approval_overview(frame(spark, sf_dir, "triples"), claims).select("kind", "corpus_id", "item_id", "place", "n_pending")


@query(
    """, e as (select distinct subject_text as name from triples), al as (select subject_text as name, string_agg(alias, '; ' order by alias) as aliases from (select distinct subject_text, upper(subject_text) as alias from triples where triple_id % 3 = 0 union select distinct subject_text, lower(subject_text) from triples where triple_id % 4 = 0) x group by 1),
    re as (select subject_text as name, count(*) as n_relations, string_agg(concat(predicate, ' ', object_text), '; ' order by predicate, object_text) as relations from triples where status = 'APPROVED' group by 1)
    select e.name, al.aliases, coalesce(n_relations, 0) as n_relations, relations from e left join al on al.name = e.name left join re on re.name = e.name""",
    "triples",
)
def entity_profile_nested(spark, sf_dir):
    """Entities with all their aliases and approved relations inside."""
    t = frame(spark, sf_dir, "triples")
    entities = t.select(F.col("subject_text").alias("name")).distinct()
    aliases = t.filter("triple_id % 3 = 0").select(F.col("subject_text").alias("name"), F.upper("subject_text").alias("alias")).union(t.filter("triple_id % 4 = 0").select("subject_text", F.lower("subject_text"))).distinct()
    out = N.entity_profile_nested(entities, aliases, t.filter("status = 'APPROVED'").select(F.col("subject_text").alias("name"), "predicate", F.col("object_text").alias("object")), ["name"])
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "; "))
    told = F.transform("relations", lambda x: F.concat_ws(" ", x["predicate"], x["object"]))
    return out.select("name", joined(F.col("aliases")).alias("aliases"), F.size("relations").cast("long").alias("n_relations"), joined(told).alias("relations"))


@query("select run_id, (max(l_shipdate_us) - min(l_shipdate_us)) // 1000 as duration_ms, count(*) filter (retrying) as n_retries, max(attempt) as max_attempt from (select cast(user_id as bigint) as run_id, epoch_us(ts) as l_shipdate_us, event_type = 'error' as retrying, cast(event_id % 6 as int) as attempt from events) x group by run_id")
def trace_duration_ms(spark, sf_dir):
    """How long each run took, its retries and the most attempts of a step."""
    e = _table(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "RETRYING").otherwise("OK").alias("status"), (F.col("event_id") % 6).cast("int").alias("attempt"))
    return W.trace_duration_ms(steps)



@query(
    f", queries as ({_CLAIM_QUERIES}), t as (select query_id, {_TOKENS} as t from queries), w as (select query_id, unnest(t) as w, generate_subscripts(t, 1) as i from t), f as (select query_id, w, min(i) as i from w group by 1, 2) select t.query_id, count(s.target) as n_applied, string_agg(f.w || '=' || s.target, '; ' order by f.i) filter (s.target is not null) as applied from t left join f on f.query_id = t.query_id left join {_SURFACES} s on s.surface = f.w group by t.query_id",
    "claims",
)
def query_expansions(spark, sf_dir):
    """What was added to each query, and for which of its words."""
    text = F.concat(F.lit("who reports and owns "), F.replace("predicate", F.lit("_"), F.lit(" ")), F.lit(" "), F.col("object_text"), F.lit(" supplier"))
    q = frame(spark, sf_dir, "claims").select(F.col("claim_id").alias("query_id"), T.applied_expansions(T.query_tokens(text)).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return q.select("query_id", F.size("m").cast("long").alias("n_applied"), F.when(F.size("m") > 0, F.array_join(pairs, "; ")).alias("applied"))


@query(_ROWS + " select corpus_id, count(*) as n, round(avg(hit1::int), 4) as recall_at_1, round(avg(hit3::int), 4) as recall_at_3, round(avg(hit5::int), 4) as recall_at_5, round(avg(rr), 6) as mrr, count(*) filter (rank is null) as n_not_retrieved from rows group by corpus_id", "docs", "queries", "gold")
def retrieval_summary_newest(spark, sf_dir):
    """Two runs are stored, the first without expansions; the summary is that of the later one."""
    run = lambda name, first, **how: E.retrieval_rows(frame(spark, sf_dir, "gold"), R.retrieve_topk(frame(spark, sf_dir, "queries"), _chunks(spark, sf_dir), **how)).withColumns({"run_key": F.lit(name), "row_id": first + F.col("query_id")})
    return E.retrieval_summary(E.newest_run(run("plain", F.lit(0), expand=False).unionByName(run("expanded", F.lit(1 << 40)))))


@query("select count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'RUNNING') as running, count(*) filter (status = 'SUCCEEDED') as succeeded, count(*) as total, (select count(distinct user_id) from events) as n_users from jobs", "jobs")
def system_overview(spark, sf_dir):
    """Jobs in each state and the users there are."""
    return W.system_overview(frame(spark, sf_dir, "jobs"), ["PENDING", "RUNNING", "SUCCEEDED"], _table(spark, sf_dir, "events").select("user_id").distinct())
