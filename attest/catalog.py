"""All queries of the library's own operators over the given tables, with their SQL.

Each entry is a function from (spark, sf_dir) to a DataFrame; ``ORACLES`` has the same result in SQL that
DuckDB runs on the tables. Inputs are the derived tables of ``fixtures``, by the same text in both.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest import vocabulary as V
from attest.fixtures import frame, register, sql
from attest.functions import scores as S
from attest.functions import text as T
from attest.operators import claims as C
from attest.operators import contradictions as X
from attest.operators import documents as D
from attest.operators import entities as N
from attest.operators import evaluation as E
from attest.operators import facts as K
from attest.operators import graph as G
from attest.operators import replies as P
from attest.operators import retrieval as R
from attest.operators import views as W
from attest.operators._store import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with(text: str, *names: str) -> str:
    """SQL over derived tables, named in front."""
    return "with " + ", ".join(f"{n} as ({sql(n, 'duckdb')})" for n in names) + "\n" + text


def query(oracle: str | None = None, *names: str):
    """Registers a function as a query, with its SQL over derived tables."""
    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = _with(oracle, *names) if names else oracle
        return f

    return put


def _list(terms: list[str]) -> str:
    return "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + ")"


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as v({columns}))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REGISTRY = _values(V.PREDICATES, "predicate, cardinality, bounded_max, is_symmetric, is_transitive, mutually_exclusive, temporal")
_NORM_LABEL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_PLAIN = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TAIL = "|".join(d.replace(".", "\\.") for d in V.DESIGNATORS)


def _key(c: str) -> str:
    edge = "[,;:\"''()\\[\\]—–]+"
    x = f"trim(regexp_replace(lower(trim({c})), '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({x}, '^{edge}|{edge}$', '', 'g'), '^(.*\\S)\\s+(?:{_TAIL})$', '\\1'))"


def _norm(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


def _hash(kind: str, s: str, p: str, a: str, b: str) -> str:
    return f"sha256(concat('{kind}|', {_norm(s)}, '|', coalesce({p}, ''), '|', least({a}, {b}), '|', greatest({a}, {b})))"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "docs").select("corpus_id", F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


# --- text ---


@query("select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), '^\\s+|\\s+$', '', 'g'))) as digest from documents")
def text_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query("select doc_id, sha256(coalesce(text, '')) as content_hash from documents")
def text_sha256(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.sha256_hex(F.col("text")).alias("content_hash"))


@query("select doc_id, cast(ceil(length(coalesce(text, '')) / 4.0) as int) as tokens from documents")
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"select doc_id, md5({_NORM_LABEL.format('text')}) as label from documents")
def norm_label(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm_label(F.col("text"))).alias("label"))


@query("select doc_id, corpus_id, sha256(text) as content_hash, min(doc_id) over (partition by corpus_id, text) as kept_id, doc_id <> min(doc_id) over (partition by corpus_id, text) as is_repeat from docs", "docs")
def doc_dedup(spark, sf_dir):
    return D.doc_dedup(frame(spark, sf_dir, "docs"))


@query("select doc_id, case when trim(text) = '' then 'EMPTY' when length(text) > 5000 then 'TOO_LONG' end as reason from documents")
def src_gate(spark, sf_dir):
    return D.gate(_table(spark, sf_dir, "documents"), 5000).select("doc_id", "reason")


_PHRASE = "' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"select q.query_id, count(*) as n from queries q join docs d on d.corpus_id = q.corpus_id where contains({_PHRASE.format('d.text')}, {_PHRASE.format('q.query_text')}) and len(string_split(trim({_PHRASE.format('q.query_text')}), ' ')) >= 3 group by q.query_id", "queries", "docs")
def phrase_contains(spark, sf_dir):
    """Documents of the same corpus that have a query's words in a row: five of its words index the documents, then the whole is compared."""
    q, d = frame(spark, sf_dir, "queries"), frame(spark, sf_dir, "docs")
    tokens = lambda c: F.split(F.trim(T.phrase(F.col(c))), " ")
    first = lambda a: F.array_join(F.slice(a, 1, 3), " ")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - 3, F.lit(0))), lambda i: F.array_join(F.slice("t", i + 1, 3), " ")))
    asked = q.withColumn("start", first(tokens("query_text")))
    keys = d.withColumn("t", tokens("text")).select("corpus_id", "doc_id", F.explode(runs).alias("start")).join(F.broadcast(asked.select("corpus_id", "start").distinct()), ["corpus_id", "start"], "left_semi")
    both = keys.join(asked, ["corpus_id", "start"]).join(d.select("doc_id", "text"), "doc_id")
    return both.filter(T.phrase_contains(F.col("text"), F.col("query_text"))).groupBy("query_id").agg(F.count("*").alias("n"))


@query("select distinct title, replace(replace(replace(title, '\\', '\\\\'), '%', '\\%'), '_', '\\_') as escaped from (select p_name || '%_' as title from part) p")
def like_escape(spark, sf_dir):
    title = F.concat("p_name", F.lit("%_"))
    return _table(spark, sf_dir, "part").select(title.alias("title"), T.like_escape(title).alias("escaped")).distinct()


@query("select doc_id, case when length(text) > 80 then substr(text, 1, 80) || '…' else text end as short from documents")
def truncate_ellipsis(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.truncate_ellipsis(F.col("text"), 80).alias("short"))


@query()
def sentence_split(spark, sf_dir):
    return D.sentence_split(_table(spark, sf_dir, "documents"))


@query()
def chunk_overlap(spark, sf_dir):
    return D.chunk_overlap(_table(spark, sf_dir, "documents"))


@query()
def chunk_content(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return D.chunk_content(D.chunk_overlap(docs), docs)


def _dealt(spark, sf_dir, most=8):
    """Facts with chunk_id: chunks of at most eight facts of one subject, so their number grows with the facts."""
    f = frame(spark, sf_dir, "facts")
    place = F.row_number().over(Window.partitionBy("s").orderBy("triple_id", "p", "o"))
    f = f.withColumn("part", F.floor((place - 1) / most))
    return f.withColumn("chunk_id", F.min("triple_id").over(Window.partitionBy("s", "part")))


@query("select subject, predicate, object_or_claim from (select s as subject, p as predicate, o as object_or_claim from facts) x", "facts")
def extract_spo_facts(spark, sf_dir):
    """All facts, written out as sentences and extracted again."""
    facts = _dealt(spark, sf_dir).select("chunk_id", F.concat_ws(" ", "s", "p", F.concat("o", F.lit("."))).alias("content"))
    out = D.extract_spo(facts.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("content")), " ").alias("content")))
    return out.filter("kind = 'TRIPLE'").select("subject", "predicate", "object_or_claim")


# --- entities ---


@query(f"select distinct s as name, {_key('s')} as entity_key from facts", "facts")
def entity_key(spark, sf_dir):
    return frame(spark, sf_dir, "facts").select(F.col("s").alias("name"), T.entity_key(F.col("s")).alias("entity_key")).distinct()


@query()
def entity_display(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", N.entity_display(F.col("c_name")).alias("display"))


_NAMES = f"select name, {_key('name')} as k from (select distinct concat(s, case cast(triple_id % 3 as int) when 0 then ' Group' when 1 then ' Ltd.' else '' end) as name from facts) x"


@query(f"select k as entity_key, count(*) as n_names, min(name) as first_name, max(name) as last_name from ({_NAMES}) n where k <> '' group by k having count(*) > 1", "facts")
def same_identity(spark, sf_dir):
    suffix = F.element_at(F.array(F.lit(" Group"), F.lit(" Ltd."), F.lit("")), (F.col("triple_id") % 3 + 1).cast("int"))
    return N.same_identity(frame(spark, sf_dir, "facts").select(F.concat("s", suffix).alias("name")))


_MENTIONS = "select corpus_id, s as name, triple_id as mention_id, triple_id % 97 as chunk_id from facts"
_ENTITIES = f"select corpus_id, k as entity_key, arg_min(name, mention_id) as display_name, arg_min(chunk_id, mention_id) as first_seen_chunk_id, count(*) as support_count from (select *, {_key('name')} as k from ({_MENTIONS}) m) x where k <> '' group by corpus_id, k"


def _mentions(spark, sf_dir):
    return frame(spark, sf_dir, "facts").select("corpus_id", F.col("s").alias("name"), F.col("triple_id").alias("mention_id"), (F.col("triple_id") % 97).alias("chunk_id"))


@query(_ENTITIES, "facts")
def entity_build(spark, sf_dir):
    return N.entity_build(_mentions(spark, sf_dir))


_LIVE = f"select *, case when support_count % 5 = 0 then 'MERGE' else 'KEEP_SEPARATE' end as resolution_state, cast('0x' || substr(md5(entity_key), 1, 12) as bigint) as entity_id from ({_ENTITIES}) e"


def _entities(spark, sf_dir):
    e = N.entity_build(_mentions(spark, sf_dir))
    return e.withColumns({"resolution_state": F.when(F.col("support_count") % 5 == 0, "MERGE").otherwise("KEEP_SEPARATE"), "entity_id": F.conv(F.substring(F.md5("entity_key"), 1, 12), 16, 10).cast("long")})


_ALIASES = "select corpus_id, entity_id, concat(display_name, ' Holding') as alias, entity_key as alias_key from live where support_count % 2 = 0 union all select corpus_id, entity_id, concat('The ', display_name), concat('the ', entity_key) from live"


def _aliases(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return e.filter("support_count % 2 = 0").select("corpus_id", "entity_id", F.concat("display_name", F.lit(" Holding")).alias("alias"), F.col("entity_key").alias("alias_key")).unionByName(e.select("corpus_id", "entity_id", F.concat(F.lit("The "), "display_name").alias("alias"), F.concat(F.lit("the "), "entity_key").alias("alias_key")))


@query(f", live as ({_LIVE}), al as ({_ALIASES}), n as (select distinct corpus_id, name, {_key('name')} as entity_key from (select corpus_id, o as name from facts union all select corpus_id, concat('The ', s) from facts union all select corpus_id, 'x' from facts) u), r as (select n.*, l.entity_id as by_key, a.entity_id as by_alias from n left join live l on l.corpus_id = n.corpus_id and l.entity_key = n.entity_key and l.resolution_state <> 'MERGE' left join al a on a.corpus_id = n.corpus_id and a.alias_key = n.entity_key) select corpus_id, name, entity_key, case when length(entity_key) < 2 then 'NEEDS_REVIEW' when coalesce(by_key, by_alias) is not null then 'ATTACH' else 'CREATE' end as action, case when length(entity_key) >= 2 then coalesce(by_key, by_alias) end as entity_id from r", "facts")
def entity_resolve(spark, sf_dir):
    f = frame(spark, sf_dir, "facts")
    names = f.select("corpus_id", F.col("o").alias("name")).unionByName(f.select("corpus_id", F.concat(F.lit("The "), "s").alias("name"))).unionByName(f.select("corpus_id", F.lit("x").alias("name"))).distinct()
    return N.entity_resolve(names, _entities(spark, sf_dir), _aliases(spark, sf_dir))


@query(f", live as ({_LIVE}), al as ({_ALIASES}), k as (select corpus_id, {_key('alias')} as alias_key, entity_id, count(*) as n from al group by all) select corpus_id, alias_key, count(*) as n_entities, min(entity_id) as entity_id, sum(n)::bigint as support_count, case when count(*) > 1 then 'CONFLICT' else 'OK' end as state from k where alias_key <> '' group by corpus_id, alias_key", "facts")
def alias_add(spark, sf_dir):
    return N.alias_add(_aliases(spark, sf_dir).select("corpus_id", "alias", "entity_id"))


@query(f", live as ({_LIVE}), al as ({_ALIASES}), a as (select entity_id, count(*) as n_aliases, min(alias) as first_alias from al group by entity_id), r as (select corpus_id, {_key('subject_text')} as entity_key, count(*) as n_relations, count(distinct predicate) as n_predicates from triples where status = 'APPROVED' group by 1, 2) select l.entity_id, l.corpus_id, l.entity_key, l.display_name, coalesce(n_aliases, 0) as n_aliases, first_alias, coalesce(n_relations, 0) as n_relations, coalesce(n_predicates, 0) as n_predicates from live l left join a on a.entity_id = l.entity_id left join r on r.corpus_id = l.corpus_id and r.entity_key = l.entity_key", "facts", "triples")
def entity_profile(spark, sf_dir):
    return N.entity_profile(_entities(spark, sf_dir), _aliases(spark, sf_dir), frame(spark, sf_dir, "triples")).select("entity_id", "corpus_id", "entity_key", "display_name", "n_aliases", "first_alias", "n_relations", "n_predicates")


@query(f", live as ({_LIVE}) select corpus_id, entity_key, display_name, support_count from live where resolution_state <> 'MERGE'", "facts")
def entity_listing(spark, sf_dir):
    return N.entity_listing(_entities(spark, sf_dir)).select("corpus_id", "entity_key", "display_name", "support_count")


@query(f", live as ({_LIVE}) select corpus_id, entity_key, display_name, support_count from live where resolution_state <> 'MERGE' and (contains(lower(display_name), 'supplier') or contains(entity_key, 'supplier')) order by support_count desc, display_name limit 200", "facts")
def entity_search(spark, sf_dir):
    return N.entity_search(_entities(spark, sf_dir), "Supplier").select("corpus_id", "entity_key", "display_name", "support_count")


@query(
    "select s_name as a, n_name as b, case when ax = '' and bx = '' then 'same tokens, different order' else concat_ws('; ', case when ax <> '' then 'only in first: ' || ax end, case when bx <> '' then 'only in second: ' || bx end) end as difference from (select s_name, n_name, array_to_string(list_sort(list_distinct(list_filter(string_split(a, ' '), lambda x: not list_contains(string_split(b, ' '), x)))), ', ') as ax, array_to_string(list_sort(list_distinct(list_filter(string_split(b, ' '), lambda x: not list_contains(string_split(a, ' '), x)))), ', ') as bx from (select s_name, n_name, lower(s_name) || ' of ' || lower(n_name) as a, lower(n_name) || ' of trade' as b from supplier join nation on n_nationkey = s_nationkey) t) u"
)
def token_difference(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    a, b = F.concat(F.lower("s_name"), F.lit(" of "), F.lower("n_name")), F.concat(F.lower("n_name"), F.lit(" of trade"))
    return rows.select(F.col("s_name").alias("a"), F.col("n_name").alias("b"), T.token_difference(a, b).alias("difference"))


# --- proposals and facts ---

_UPSERT = f"select corpus_id, fact_hash, predicate, arg_min(triple_id, triple_id) as triple_id, arg_min(subject_text, triple_id) as subject_text, arg_min(object_text, triple_id) as object_text, count(*) as evidence_chunk_count from (select *, sha256(concat({_key('subject_text')}, '|', predicate, '|', {_key('object_text')})) as fact_hash from triples where {_key('subject_text')} <> '' and {_key('object_text')} <> '') x group by corpus_id, fact_hash, predicate"


@query(_UPSERT, "triples")
def triple_upsert(spark, sf_dir):
    return K.triple_upsert(frame(spark, sf_dir, "triples"))


@query("select corpus_id, sha256(concat(subject, '|', claim_text, '|', polarity)) as claim_hash, min(claim_id) as claim_id, count(*) as n_repeats from claims group by corpus_id, subject, claim_text, polarity", "claims")
def claim_dedup(spark, sf_dir):
    return K.claim_dedup(frame(spark, sf_dir, "claims"))


@query("select decision_id, item_id, decision, case when row_number() over (partition by item_id order by decided_at, decision_id) = 1 then 'APPLIED' else 'CONFLICT' end as outcome from decisions", "decisions")
def approval_apply(spark, sf_dir):
    return K.approval_apply(frame(spark, sf_dir, "decisions")).select("decision_id", "item_id", "decision", "outcome")


@query("select item_id, case decision when 'APPROVE' then 'APPROVED' when 'REJECT' then 'REJECTED' else 'PENDING' end as status, coalesce(n, 0) as n_decisions from (select c_custkey as item_id from customer) c left join (select item_id as i, arg_min(decision, (decided_at, decision_id)) as decision, count(*) as n from decisions group by item_id) d on d.i = c.item_id", "decisions")
def item_states(spark, sf_dir):
    return K.item_states(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id")), frame(spark, sf_dir, "decisions"))


@query("select corpus_id, count(*) as asked, count(*) filter (status = 'PENDING') as approved, count(*) filter (status <> 'PENDING') as skipped from triples where triple_id % 3 = 0 group by corpus_id", "triples")
def bulk_approve(spark, sf_dir):
    t = frame(spark, sf_dir, "triples")
    return K.bulk_approve(t, t.filter("triple_id % 3 = 0").select("triple_id"))


@query("select corpus_id, triple_id, place from (select *, row_number() over (partition by corpus_id order by triple_id desc) as place from triples where status = 'PENDING') x where place <= 50", "triples")
def approval_queue(spark, sf_dir):
    return K.approval_queue(frame(spark, sf_dir, "triples")).select("corpus_id", "triple_id", "place")


@query("select triple_id, subject_text, predicate, object_text from triples where status = 'APPROVED'", "triples")
def approved_triples(spark, sf_dir):
    return K.approved(frame(spark, sf_dir, "triples")).select("triple_id", "subject_text", "predicate", "object_text")


@query("select triple_id, predicate from triples where subject_text in (select s_name from supplier where s_suppkey % 10 = 0) or object_text in (select s_name from supplier where s_suppkey % 10 = 0)", "triples")
def triples_of_entity(spark, sf_dir):
    names = _table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("name"))
    return K.triples_of_entity(frame(spark, sf_dir, "triples"), names).select("triple_id", "predicate")


@query(f"select t.triple_id, coalesce(r.cardinality, 'MULTI') as cardinality, coalesce(r.cardinality = 'SINGLE' and r.mutually_exclusive, false) as holds_one, r.predicate is not null as known from triples t left join {_REGISTRY} r on r.predicate = lower(t.predicate)", "triples")
def predicate_registry(spark, sf_dir):
    return K.with_predicate(frame(spark, sf_dir, "triples")).select("triple_id", "cardinality", "holds_one", "known")


@query(f"select coalesce(u.predicate, r.predicate) as predicate, coalesce(n, 0) as n, case when n is null then 'NEVER_USED' when r.predicate is null then 'UNREGISTERED' else 'USED' end as state from (select lower(predicate) as predicate, count(*) as n from triples group by 1) u full join {_REGISTRY} r on r.predicate = u.predicate", "triples")
def predicate_coverage(spark, sf_dir):
    return K.predicate_coverage(frame(spark, sf_dir, "triples"))


@query(
    "select o_orderkey as row_key, 'status_known' as rule from orders where o_orderstatus not in ('O', 'F') union all select o_orderkey, 'price_below_cap' from orders where not (o_totalprice < 200000) union all select o_custkey, 'customer_exists' from orders where o_custkey not in (select c_custkey from customer where c_custkey % 50 <> 0) union all select c_nationkey, 'one_customer_a_nation' from customer group by c_nationkey having count(*) > 1"
)
def constraint_audit(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rules = {"status_known": F.col("o_orderstatus").isin("O", "F"), "price_below_cap": F.col("o_totalprice") < 200000}
    return K.bad_rows(o, "o_orderkey", rules).unionByName(K.orphans(o, "o_custkey", c.filter("c_custkey % 50 <> 0"), "c_custkey", "customer_exists")).unionByName(K.repeats(c, ["c_nationkey"], "one_customer_a_nation"))


# --- claims and verdicts ---

_PHRASE_COUNT = " + ".join(f"len(regexp_extract_all(x, '\\b{p}\\b'))" for p in V.ABSOLUTE_PHRASES)
_RULES = f"""select claim_id, corpus_id, claim_text, subject, predicate, object_text, weasels, absolutes, floor(least(weasels * 0.04::double + absolutes * 0.06::double, 0.4::double) * 1000 + 0.5) / 1000 as penalty from (
  select *, cast(len(list_filter(t, lambda w: w in {_list(V.WEASEL_TERMS)})) as int) as weasels,
    cast(len(list_filter(t, lambda w, i: w in {_list(V.ABSOLUTE_TERMS)} and (i = 1 or t[i - 1] not in {_list(V.NEGATORS)}))) + {_PHRASE_COUNT} as int) as absolutes
  from (select *, string_split(x, ' ') as t from (select *, {_PLAIN.format('claim_text')} as x from claims) a) b) c"""


@query(f"select claim_id, weasels, absolutes, penalty from ({_RULES}) r", "claims")
def claim_rules(spark, sf_dir):
    return C.claim_rules(frame(spark, sf_dir, "claims")).select("claim_id", "weasels", "absolutes", "penalty")


@query(
    f"""select claim_id, 'WEASEL' as category, w as term, cast(i - 1 as int) as place from (select claim_id, unnest(t) as w, generate_subscripts(t, 1) as i from (select claim_id, string_split({_PLAIN.format('claim_text')}, ' ') as t from claims) a) b where w in {_list(V.WEASEL_TERMS)}
    union all select claim_id, 'ABSOLUTE', w, cast(i - 1 as int) from (select claim_id, t, unnest(t) as w, generate_subscripts(t, 1) as i from (select claim_id, string_split({_PLAIN.format('claim_text')}, ' ') as t from claims) a) b where w in {_list(V.ABSOLUTE_TERMS)} and (i = 1 or t[i - 1] not in {_list(V.NEGATORS)})
    """
    + "".join(f" union all select claim_id, 'ABSOLUTE_PHRASE', unnest(regexp_extract_all({_PLAIN.format('claim_text')}, '\\b{p}\\b')), -1 from claims" for p in V.ABSOLUTE_PHRASES),
    "claims",
)
def claim_rule_hits(spark, sf_dir):
    return C.claim_rule_hits(frame(spark, sf_dir, "claims"))


@query()
def claim_rule_explain(spark, sf_dir):
    return C.claim_rule_explain(frame(spark, sf_dir, "claims"))


_SETTLED = f"select r.claim_id, r.corpus_id, r.subject, r.predicate, r.object_text, j.evidence, case when j.evidence = 'NO_EVIDENCE' then 'SOURCE_MISSING' when j.judge_verdict = 'SUPPORTED' and penalty >= 0.1 and (score is null or score < 0.6) then 'EXAGGERATED' else judge_verdict end as verdict, case when score is not null then floor(score * (1 - penalty) * 1000 + 0.5) / 1000 end as fused from ({_RULES}) r join judge j on j.claim_id = r.claim_id"
_STATE = "case when evidence <> 'EVIDENCE_FOUND' or verdict in ('CONTRADICTED', 'EXAGGERATED', 'SOURCE_MISSING') then 'CONTESTED' else 'MACHINE_ONLY' end"


def _settled(spark, sf_dir):
    c = C.claim_rules(frame(spark, sf_dir, "claims")).join(frame(spark, sf_dir, "judge").drop("corpus_id"), "claim_id")
    return C.settle(c)


@query(f"select claim_id, fused from ({_SETTLED}) s", "claims", "judge")
def fuse_score(spark, sf_dir):
    return _settled(spark, sf_dir).select("claim_id", "fused")


@query(f"select claim_id, verdict from ({_SETTLED}) s", "claims", "judge")
def resolve_verdict(spark, sf_dir):
    return _settled(spark, sf_dir).select("claim_id", "verdict")


@query(f"select claim_id, {_STATE} as state from ({_SETTLED}) s", "claims", "judge")
def needs_adjudication(spark, sf_dir):
    return _settled(spark, sf_dir).select("claim_id", "state")


@query("select claim_id, concat_ws(' ', nullif(trim(subject), ''), nullif(trim(claim_text), ''), nullif(trim(replace(predicate, '_', ' ')), ''), nullif(trim(object_text), '')) as q from claims", "claims")
def evidence_query(spark, sf_dir):
    return frame(spark, sf_dir, "claims").select("claim_id", T.evidence_query(F.col("subject"), F.col("claim_text"), F.col("predicate"), F.col("object_text")).alias("q"))


@query(f"select corpus_id, verdict, count(*) as n from ({_SETTLED}) s group by corpus_id, verdict", "claims", "judge")
def verdict_counts(spark, sf_dir):
    return W.status_counts(_settled(spark, sf_dir), ["corpus_id", "verdict"])


@query("select verdict_id, claim_id, created_at, lead(created_at) over w as superseded_at, lead(verdict_id) over w is null as is_current from (select event_id as verdict_id, user_id as claim_id, cast(ts as date) as created_at from events) v window w as (partition by claim_id order by created_at, verdict_id)")
def verdict_supersede(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("event_id").alias("verdict_id"), F.col("user_id").alias("claim_id"), F.to_date("ts").alias("created_at"))
    return C.verdict_supersede(log)


@query(
    f"""select s.claim_id, s.verdict, human_verdict, coalesce(human_verdict, s.verdict) as effective, coalesce(human_verdict <> s.verdict, false) as overridden, coalesce(n - 1, 0) as n_refused from (select claim_id, verdict, claim_id % 2000 as item from ({_SETTLED}) x) s
    left join (select item_id, arg_min(case decision when 'APPROVE' then 'SUPPORTED' else 'CONTRADICTED' end, (decided_at, decision_id)) as human_verdict, count(*) as n from decisions group by item_id) d on d.item_id = s.item""",
    "claims", "judge", "decisions",
)
def verdict_adjudicate(spark, sf_dir):
    d = frame(spark, sf_dir, "decisions").select(F.col("item_id").alias("claim_id"), F.when(F.col("decision") == "APPROVE", "SUPPORTED").otherwise("CONTRADICTED").alias("human_verdict"), "decided_at", "decision_id")
    v = _settled(spark, sf_dir).select(F.col("claim_id").alias("own_id"), (F.col("claim_id") % 2000).alias("claim_id"), "verdict")
    return C.verdict_adjudicate(v, d).drop("claim_id").withColumnRenamed("own_id", "claim_id")


@query("select event_id, own, case when not own then 'CROSS_CORPUS_ATTEMPT_BLOCKED' end as reason from (select e.event_id, e.event_id % 4 = d.corpus_id as own from events e join docs d on d.doc_id = e.user_id) x", "docs")
def verdict_evidence(spark, sf_dir):
    p = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("corpus_id"), F.col("user_id").alias("chunk_id"))
    own, refused = C.verdict_evidence(p, _chunks(spark, sf_dir))
    return own.select("event_id", F.lit(True).alias("own"), F.lit(None).cast("string").alias("reason")).unionByName(refused.select("event_id", F.lit(False).alias("own"), "reason"))


# --- retrieval ---

_TOKENS = f"list_filter(string_split({_NORM_LABEL.format('query_text')}, ' '), lambda w: length(w) >= 3 and w not in {_list(V.STOP_TERMS)})[1:12]"
_SURFACES = _values([(s, t) for t, ss in V.EXPANSIONS.items() for s in ss.split() if s != t], "surface, target")


@query(f"select query_id, corpus_id, array_to_string({_TOKENS}, ' ') as tokens from queries", "queries")
def query_tokens(spark, sf_dir):
    return frame(spark, sf_dir, "queries").select("query_id", "corpus_id", F.array_join(T.query_tokens(F.col("query_text")), " ").alias("tokens"))


_CLAIM_QUERIES = "select claim_id as query_id, corpus_id, concat('who reports and owns ', replace(predicate, '_', ' '), ' ', object_text, ' supplier') as query_text from claims"


@query(f", queries as ({_CLAIM_QUERIES}), t as (select query_id, {_TOKENS} as t from queries), w as (select query_id, unnest(t) as w, generate_subscripts(t, 1) as i from t) select query_id, string_agg('+' || w || coalesce(' +' || target, ''), ' ' order by i) as fulltext_query from w left join {_SURFACES} s on s.surface = w.w group by query_id", "claims")
def query_expand(spark, sf_dir):
    text = F.concat(F.lit("who reports and owns "), F.replace("predicate", F.lit("_"), F.lit(" ")), F.lit(" "), F.col("object_text"), F.lit(" supplier"))
    return frame(spark, sf_dir, "claims").select(F.col("claim_id").alias("query_id"), T.expanded_query(T.query_tokens(text)).alias("fulltext_query"))


_TERMS = "select corpus_id, chunk_id, term, count(*) as tf from (select corpus_id, doc_id as chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from docs) x where length(term) >= 3 group by all"
_ASKED = f"select distinct corpus_id, query_id, term from (select corpus_id, query_id, unnest({_TOKENS}) as term from queries union all select q.corpus_id, q.query_id, s.target from (select corpus_id, query_id, unnest({_TOKENS}) as term from queries) q join {_SURFACES} s on s.surface = q.term) y"
_SCORED = f", terms as ({_TERMS}), asked as ({_ASKED}), n as (select corpus_id, count(*) as n_chunks from docs group by corpus_id), df as (select corpus_id, term, count(*) as df from terms group by corpus_id, term), scored as (select a.corpus_id, a.query_id, t.chunk_id, round(sum(tf * log10(n_chunks / df.df) * log10(n_chunks / df.df)), 6) as score from asked a join terms t on t.corpus_id = a.corpus_id and t.term = a.term join df on df.corpus_id = a.corpus_id and df.term = a.term join n on n.corpus_id = a.corpus_id group by all)"
_TOP = _SCORED + ", top as (select * from (select *, row_number() over (partition by corpus_id, query_id order by score desc, chunk_id) as rank from scored where score > 0) x where rank <= 5)"


@query(f"select corpus_id, chunk_id, count(*) as n_terms, sum(tf)::bigint as n_words from ({_TERMS}) t group by corpus_id, chunk_id", "docs")
def index_terms(spark, sf_dir):
    return R.index_terms(_chunks(spark, sf_dir)).groupBy("corpus_id", "chunk_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_words"))


def _found(spark, sf_dir, **how):
    return R.retrieve_topk(frame(spark, sf_dir, "queries"), _chunks(spark, sf_dir), **how)


@query(_TOP + " select corpus_id, query_id, chunk_id, rank from top", "docs", "queries")
def retrieve_topk(spark, sf_dir):
    return _found(spark, sf_dir).select("corpus_id", "query_id", "chunk_id", "rank")


@query(
    f", terms as ({_TERMS}), asked as ({_ASKED}), n as (select corpus_id, count(*) as n_chunks from docs group by corpus_id), df as (select corpus_id, term, count(*) as df from terms group by corpus_id, term), z as (select corpus_id, chunk_id, sum(tf) as len from terms group by corpus_id, chunk_id), m as (select corpus_id, avg(len) as mean_len from z group by corpus_id), "
    "scored as (select a.corpus_id, a.query_id, t.chunk_id, round(sum(ln(1 + (n_chunks - df.df + 0.5::double) / (df.df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean_len))), 6) as score from asked a join terms t on t.corpus_id = a.corpus_id and t.term = a.term join df on df.corpus_id = a.corpus_id and df.term = a.term join n on n.corpus_id = a.corpus_id join z on z.corpus_id = t.corpus_id and z.chunk_id = t.chunk_id join m on m.corpus_id = a.corpus_id group by all) "
    "select corpus_id, query_id, chunk_id, rank from (select *, row_number() over (partition by corpus_id, query_id order by score desc, chunk_id) as rank from scored where score > 0) x where rank <= 5",
    "docs", "queries",
)
def retrieve_bm25(spark, sf_dir):
    return R.retrieve_bm25(frame(spark, sf_dir, "queries"), _chunks(spark, sf_dir)).select("corpus_id", "query_id", "chunk_id", "rank")


@query(_TOP + f" select q.corpus_id, q.query_id, coalesce(k.n, 0) as n_kept, case when len({_TOKENS}) = 0 then 'query contained no searchable keywords after normalisation' when k.n is null then 'no chunk in this corpus matched the query terms' end as reason from queries q left join (select corpus_id, query_id, count(*) as n from top group by all) k on k.corpus_id = q.corpus_id and k.query_id = q.query_id", "docs", "queries")
def retrieve_diagnose(spark, sf_dir):
    return R.retrieve_diagnose(frame(spark, sf_dir, "queries"), _found(spark, sf_dir)).select("corpus_id", "query_id", "n_kept", "reason")


@query(_TOP + " select q.corpus_id, q.query_id, case when exists (select 1 from top t where t.corpus_id = q.corpus_id and t.query_id = q.query_id) then 'EVIDENCE_FOUND' else 'NO_EVIDENCE' end as evidence from queries q", "docs", "queries")
def evidence_status(spark, sf_dir):
    return R.evidence_status(frame(spark, sf_dir, "queries"), _found(spark, sf_dir))


# --- contradictions ---

_PAIRS = f"""select * from (select t.*, r.cardinality, r.bounded_max, r.mutually_exclusive, r.temporal, lead(triple_id) over w as next_id, lead(object_text) over w as next_object, lead(effective_time) over w as next_time, count(*) over (partition by corpus_id, {_norm('subject_text')}, lower(t.predicate)) as n_in_group
  from triples t join {_REGISTRY} r on r.predicate = lower(t.predicate) where status = 'APPROVED' window w as (partition by corpus_id, {_norm('subject_text')}, lower(t.predicate) order by object_text, triple_id)) x
  where next_id is not null and {_norm('object_text')} <> {_norm('next_object')} and not (temporal and coalesce(trim(effective_time) <> '', false) and coalesce(trim(next_time) <> '', false) and lower(effective_time) <> lower(next_time))"""
_RELATION = f"select corpus_id, 'RELATION_CONFLICT' as conflict_type, case when cardinality = 'SINGLE' and mutually_exclusive then 'RELATION_SINGLE_VALUE' else 'RELATION_BOUNDED_EXCEEDED' end as rule_code, subject_text, predicate, triple_id as left_triple_id, next_id as right_triple_id, cast(null as bigint) as left_claim_id, cast(null as bigint) as right_claim_id, {_hash('RELATION_CONFLICT', 'subject_text', 'predicate', 'triple_id', 'next_id')} as conflict_hash from ({_PAIRS}) p where (cardinality = 'SINGLE' and mutually_exclusive) or (cardinality = 'BOUNDED' and n_in_group > bounded_max)"
_POLARITY = f"select corpus_id, 'POLARITY_CONFLICT' as conflict_type, 'POLARITY_OPPOSITE' as rule_code, s as subject_text, p as predicate, cast(null as bigint) as left_triple_id, cast(null as bigint) as right_triple_id, a as left_claim_id, b as right_claim_id, {_hash('POLARITY_CONFLICT', 's', 'p', 'a', 'b')} as conflict_hash from (select corpus_id, arg_min(subject, claim_id) filter (polarity = 'POSITIVE') as s, arg_min(predicate, claim_id) filter (polarity = 'POSITIVE') as p, min(claim_id) filter (polarity = 'POSITIVE') as a, min(claim_id) filter (polarity = 'NEGATIVE') as b from claims group by corpus_id, subject, lower(predicate), {_norm('object_text')}) x where a is not null and b is not null"
_AGAINST_ALL = f"select distinct t.corpus_id, 'VERDICT_CONFLICT' as conflict_type, 'VERDICT_CONTRADICTS_FACT' as rule_code, t.subject_text, t.predicate, t.triple_id as left_triple_id, cast(null as bigint) as right_triple_id, cast(null as bigint) as left_claim_id, s.claim_id as right_claim_id, {_hash('VERDICT_CONFLICT', 't.subject_text', 't.predicate', 't.triple_id', 's.claim_id')} as conflict_hash from triples t join ({_SETTLED}) s on s.corpus_id = t.corpus_id and {_norm('s.subject')} = {_norm('t.subject_text')} and {_norm('s.predicate')} = {_norm('t.predicate')} and {_norm('s.object_text')} = {_norm('t.object_text')} where t.status = 'APPROVED' and s.verdict = 'CONTRADICTED'"
_AGAINST = f"select * exclude (nth) from (select *, row_number() over (partition by corpus_id, conflict_hash order by left_triple_id, right_claim_id) as nth from ({_AGAINST_ALL}) a) b where nth = 1"


def _approved(spark, sf_dir):
    return K.approved(frame(spark, sf_dir, "triples"))


def _verdicts(spark, sf_dir):
    return _settled(spark, sf_dir).withColumn("verdict_id", F.col("claim_id"))


@query(f"select * from ({_RELATION}) r where rule_code = 'RELATION_SINGLE_VALUE'", "triples")
def conflict_single(spark, sf_dir):
    return X.conflict_single(_approved(spark, sf_dir))


@query(f"select * from ({_RELATION}) r where rule_code = 'RELATION_BOUNDED_EXCEEDED'", "triples")
def conflict_bounded(spark, sf_dir):
    return X.conflict_bounded(_approved(spark, sf_dir))


@query(_POLARITY, "claims")
def conflict_polarity(spark, sf_dir):
    return X.conflict_polarity(frame(spark, sf_dir, "claims"))


@query(_AGAINST, "triples", "claims", "judge")
def conflict_verdict(spark, sf_dir):
    return X.conflict_verdict(_approved(spark, sf_dir), _verdicts(spark, sf_dir))


@query(f"select s.claim_id, {_hash('POLARITY_CONFLICT', 'subject', 'predicate', 'claim_id', 'claim_id + 1')} as conflict_hash from claims s", "claims")
def conflict_hash(spark, sf_dir):
    return frame(spark, sf_dir, "claims").select("claim_id", X.conflict_hash("POLARITY_CONFLICT", F.col("subject"), F.col("predicate"), F.col("claim_id") + 1, F.col("claim_id")).alias("conflict_hash"))


@query("select a.triple_id, coalesce(trim(a.effective_time) <> '', false) and cast(a.triple_id % 5 + 1994 as varchar) <> a.effective_time as differ from triples a where a.effective_time is not null", "triples")
def temporal_filter(spark, sf_dir):
    t = frame(spark, sf_dir, "triples").filter("effective_time is not null")
    return t.select("triple_id", X.times_differ(F.col("effective_time"), (F.col("triple_id") % 5 + 1994).cast("string")).alias("differ"))


_SCAN = f"select * from ({_RELATION}) a union all select * from ({_POLARITY}) b union all select * from ({_AGAINST}) c"


@query(f"select * from ({_SCAN}) s where not (coalesce(left_triple_id, left_claim_id) % 4 = 0)", "triples", "claims", "judge")
def contradiction_scan(spark, sf_dir):
    from attest.plans.scan import contradiction_scan as scan

    found = saved(scan(_approved(spark, sf_dir), frame(spark, sf_dir, "claims"), _verdicts(spark, sf_dir)), "findings")  # once: it is on both sides of the anti join
    stored = found.filter("coalesce(left_triple_id, left_claim_id) % 4 = 0")
    return X.new_only(found, stored).select(*X.COLUMNS)


@query()
def contradiction_lifecycle(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("DEBATE", "RESOLVE", "DISMISS", "ABORT")))
    return X.contradiction_lifecycle(e.select(F.col("user_id").alias("contradiction_id"), F.col("ts").alias("at"), "event_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("event")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts -> keys -> one row a fact -> conflicts."""
    return X.relation_conflicts(K.approved(frame(spark, sf_dir, "triples")))


from attest import catalog_views, catalog_documents, catalog_streams, catalog_quality  # noqa: E402, F401, I001  (they register the rest)
