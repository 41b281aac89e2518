"""Domain tables derived from the given ones, in SQL that Spark and DuckDB both run.

``sql(name, dialect)`` gives the text of a derived table and ``frame(spark, sf_dir, name)`` the
DataFrame. Ids of facts come from a hash of their content, so they need no order over all rows.
"""

from pyspark.sql import DataFrame, SparkSession

from attest.operators._store import saved

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages", "embeddings")


def key(text: str, dialect: str) -> str:
    """A bigint from the first 60 bits of a text's MD5."""
    return f"cast(conv(substr(md5({text}), 1, 13), 16, 10) as bigint)" if dialect == "spark" else f"cast('0x' || substr(md5({text}), 1, 13) as bigint)"


#: The facts of lines and of orders as Spark makes them: lines are joined with parts and suppliers once, orders with customers once, and each row gives two facts.
_SPARK_FACTS = """
        select inline(array(struct(p_name as s, 'sources_from' as p, s_name as o, cast(null as string) as t), struct(s_name as s, 'supplies' as p, p_name as o, cast(null as string) as t))) from (select distinct p_name, s_name from (select distinct p_name, l_suppkey from lineitem join part on p_partkey = l_partkey) l join supplier on s_suppkey = l_suppkey) x
        union all select distinct s, p, o, t from (select inline(array(struct(c_name as s, 'reports_to' as p, o_orderpriority as o, cast(null as string) as t), struct(c_name as s, 'chief_executive' as p, o_orderstatus as o, cast(year(cast(o_orderdate as date)) as string) as t))) from orders join customer on c_custkey = o_custkey) y
        union all select distinct s_name, 'located_in', n_name, cast(null as string) from supplier join nation on n_nationkey = s_nationkey
        union all select distinct n_name, 'part_of', r_name, cast(null as string) from nation join region on r_regionkey = n_regionkey"""

#: The edges as Spark makes them: orders meet their customers before the lines, and what is made distinct is the pairs of keys.
_SPARK_EDGES = """
        select cast(l_suppkey as bigint) as subject_id, 'supplies' as predicate, cast(c_custkey + 1000000 as bigint) as object_id from (select /*+ shuffle_hash(o) */ distinct l_suppkey, c_custkey from (select l_orderkey, l_suppkey from lineitem join (select distinct s_suppkey from supplier) s on s_suppkey = l_suppkey) l join (select o_orderkey, c_custkey from orders join customer on c_custkey = o_custkey) o on o_orderkey = l_orderkey) x"""


def sql(name: str, dialect: str) -> str:
    """The text of a derived table, as a query on the given tables."""
    day = "cast(o_orderdate as date)"
    plain = f"""
        select distinct p_name as s, 'sources_from' as p, s_name as o, cast(null as string) as t from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
        union all select distinct c_name, 'reports_to', o_orderpriority, cast(null as string) from orders join customer on c_custkey = o_custkey
        union all select distinct c_name, 'chief_executive', o_orderstatus, cast(year({day}) as string) from orders join customer on c_custkey = o_custkey
        union all select distinct s_name, 'located_in', n_name, cast(null as string) from supplier join nation on n_nationkey = s_nationkey
        union all select distinct n_name, 'part_of', r_name, cast(null as string) from nation join region on r_regionkey = n_regionkey
        union all select distinct s_name, 'supplies', p_name, cast(null as string) from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey"""
    facts = f"""
      select {key("concat_ws('|', p, s, o, coalesce(t, ''))", dialect)} as triple_id, cast(1 as bigint) as corpus_id, s, p, o, t from ({_SPARK_FACTS if dialect == "spark" else plain}) x"""
    claims = f"""
      select triple_id as claim_id, corpus_id, s as subject, concat(case cast(triple_id % 6 as int) when 0 then 'reportedly ' when 1 then 'always ' when 2 then 'not guaranteed ' when 3 then 'without exception ' when 4 then 'may ' else '' end, s, ' ', p, ' ', o) as claim_text,
             case when triple_id % 7 = 0 then 'NEGATIVE' when triple_id % 5 = 0 then 'NEUTRAL' else 'POSITIVE' end as polarity, p as predicate, o as object_text, t as effective_time, triple_id % 5 as status_no from ({facts}) f
      union all
      select triple_id + 1, corpus_id, s, concat(s, ' ', p, ' ', o), case when triple_id % 7 = 0 then 'POSITIVE' else 'NEGATIVE' end, p, o, t, triple_id % 5 from ({facts}) g where triple_id % 11 = 0"""
    found = {
        "facts": facts,
        "claims": claims,
        "docs": "select doc_id, doc_id % 4 as corpus_id, text, source as title, lang from documents",
        "queries": "select item_id as query_id, cast(i as bigint) as corpus_id, text as query_text from benchmark cross join (select 0 as i union all select 1 union all select 2 union all select 3) c",
        "gold": "select b.item_id as query_id, d.corpus_id, b.text as query_text, min(d.doc_id) as gold_chunk_id from benchmark b join (select doc_id, doc_id % 4 as corpus_id, text from documents) d on {contains} group by b.item_id, d.corpus_id, b.text".replace("{contains}", "contains(d.text, b.text)"),
        "judge": f"select claim_id, corpus_id, case cast(claim_id % 5 as int) when 0 then 'SUPPORTED' when 1 then 'CONTRADICTED' when 2 then 'EXAGGERATED' when 3 then 'INSUFFICIENT_EVIDENCE' else 'SUPPORTED' end as judge_verdict, case when claim_id % 9 = 0 then null else cast(claim_id % 11 as double) / 10.0 end as score, case when claim_id % 13 = 0 then 'NO_EVIDENCE' else 'EVIDENCE_FOUND' end as evidence from ({claims}) c",
        "decisions": "select event_id as decision_id, user_id as item_id, case event_type when 'purchase' then 'APPROVE' when 'error' then 'REJECT' end as decision, ts as decided_at from events where event_type in ('purchase', 'error')",
        "edges": _SPARK_EDGES if dialect == "spark" else "select distinct cast(s_suppkey as bigint) as subject_id, 'supplies' as predicate, cast(c_custkey + 1000000 as bigint) as object_id from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey",
        "jobs": f"select cast(o_orderkey as bigint) as job_id, cast(o_custkey as bigint) as document_id, case o_orderstatus when 'O' then 'RUNNING' when 'F' then 'SUCCEEDED' else 'PENDING' end as status, cast(o_orderkey % 6 as int) as attempt_count, 5 as max_attempts, case when o_orderkey % 17 = 0 then null else {day} end as heartbeat from orders",
        "steps": "select cast(l_orderkey as bigint) * 100 + seq as step_id, cast(l_orderkey as bigint) as run_id, case when seq % 2 = 0 then cast(l_orderkey as bigint) * 100 + seq - 1 end as parent_step_id, seq, case cast(seq % 3 as int) when 0 then 'ENGINE' when 1 then 'LLM' else 'HUMAN' end as actor_type, case when l_returnflag = 'R' then 'RETRYING' when l_returnflag = 'A' then 'FAILED' else 'OK' end as status, cast(l_quantity as int) as attempt, cast(l_shipdate as date) as happened_on from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq from lineitem) x",
        "messages": "select conv_id as session_id, turn, upper(role) as role, text as content from conversations",
        "requests": "select user_id, event_id, ts, event_type from events",
        "debates": "select cast(o_orderkey as bigint) as debate_id, cast(o_custkey as bigint) as contradiction_id, cast(o_custkey % 4 as bigint) as corpus_id, case o_orderstatus when 'O' then 'ROUND_ACTIVE' when 'F' then 'COMPLETED' else 'AWAITING_CHAIR' end as state from orders",
        "arguments": "select cast(l_orderkey as bigint) * 100 + n as argument_id, cast(l_orderkey as bigint) as debate_id, cast(l_orderkey as bigint) * 10 + cast(l_linenumber as bigint) as round_id, cast(l_linenumber as int) as round_number, case cast(n % 3 as int) when 0 then 'HAWK' when 1 then 'DOVE' else 'SKEPTIC' end as persona, l_returnflag = 'R' as failed, cast(l_suppkey as bigint) as source_id from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem) x",
    }
    found["weights"] = f"select argument_id * 10 + k as weight_id, argument_id, cast((argument_id + k * 3) % 7 as int) as weight, source_id as verifier_id from ({found['arguments']}) a cross join (select 1 as k union all select 2 union all select 3) ks where (argument_id + k) % 4 <> 0"
    found["triples"] = f"select triple_id, corpus_id, s as subject_text, p as predicate, o as object_text, t as effective_time, case when triple_id % 10 < 8 then 'APPROVED' when triple_id % 10 = 8 then 'PENDING' else 'REJECTED' end as status, triple_id % (select max(doc_id) + 1 from documents) as source_chunk_id from ({facts}) f"
    found["extraction"] = f"select s, p, o, triple_id % 23 as chunk_id, triple_id % 10 < 8 as in_gold, triple_id % 10 >= 1 as predicted, case when triple_id % 17 = 0 then concat(o, ' x') else o end as predicted_o from ({facts}) f"
    return found[name]


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Views of the given tables under their names; plans already made from older views keep theirs."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


#: Derived tables that others are made of: written once for a session and a folder of tables. Triples are columns of stored facts.
STORED = ("claims", "facts", "arguments", "steps", "edges", "judge")
_written: dict[tuple, DataFrame] = {}


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of the given tables from another: the session, the folder, and each table's time and length."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(sf_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for x in fs.listStatus(to_path(sf_dir))]
    return spark.sparkContext.applicationId, sf_dir, tuple(sorted((x.getPath().getName(), x.getModificationTime(), x.getLen()) for x in found))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (stamp(spark, sf_dir), name)
    if key in _written:
        return _written[key]
    text = sql(name, "spark")
    for base in STORED:
        inner = f"({sql(base, 'spark')})"
        if base != name and inner in text:
            view = f"stored_{base}"
            frame(spark, sf_dir, base).createOrReplaceTempView(view)
            text = text.replace(inner, view)
    register(spark, sf_dir, tuple(t for t in TABLES if t in text))
    out = spark.sql(text)
    if name in STORED:
        out = _written[key] = saved(out, f"derived-{name}")
    return out
