"""One query for each operator, over its whole tables, and its SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, audit_sql, fingerprints, langid, lexical, lexical_sql, licences, media, mixing, neardup, packing, secret_scan, tokens, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_documents(spark, sf_dir))


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_documents(spark, sf_dir))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.read_back(spark, tokens.write(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(_documents(spark, sf_dir))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_documents(spark, sf_dir))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_language": op2_language,
    "op3_near": op3_near,
    "op4_media": op4_media,
    "op5_secrets": op5_secrets,
    "op6_pack": op6_pack,
    "op7_warc": op7_warc,
    "op8_tokens": op8_tokens,
    "op9_fingerprints": op9_fingerprints,
    "op10_licences": op10_licences,
    "op11_audit": op11_audit,
    "op12_search": op12_search,
    "op13_toxicity": op13_toxicity,
}

#: The targets and inclusion probabilities by the same rule; then every document's rank and the running size of its source by rank.
OP1_SQL = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, case (place - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s),
r as (select *, 2 * source_size / weight as cap from w),
l as (select *, (1.5::double * (select sum(source_size) from s) - 2 * coalesce(sum(source_size) over (order by cap, place rows between unbounded preceding and 1 preceding), 0))
         / ((select sum(weight) from w) - coalesce(sum(weight) over (order by cap, place rows between unbounded preceding and 1 preceding), 0)) as level from r),
v as (select level from l where level <= cap order by cap, place limit 1),
t as (select source, source_size, coalesce(least(2.0::double * source_size, (select level from v) * weight), 2.0::double * source_size) as target from l),
e as (select *, case when source_size > 0 then target / source_size else 0 end as e from t),
p as (select *, floor(e)::bigint as whole, target - floor(e) * source_size as rest from e),
c as (select source, length(bin(size))::bigint as bits, sum(size)::bigint as class_size from d group by all),
h as (select c.*, rest, rest - coalesce(sum(class_size) over (partition by c.source order by bits desc rows between unbounded preceding and 1 preceding), 0) as left_,
         sum(bits * class_size) over (partition by c.source order by bits desc rows between current row and unbounded following) as more from c join p on c.source is not distinct from p.source),
i as (select *, max(case when left_ / nullif(more, 0) * bits <= 1 then bits end) over (partition by source) as top_bits from h),
j as (select source, any_value(left_) as left_, any_value(left_ / nullif(more, 0)) as c from i where bits = top_bits group by source),
o1 as (select i.source, bits, coalesce(j.left_, 0) as left_, case when rest <= 0 then 0 when bits > top_bits then 1 else coalesce(c * bits, 0) end as p from i left join j on i.source is not distinct from j.source),
u as (select d.doc_id, d.source, d.size, source_size, target, whole + case when o1.p >= 1 then 1 else 0 end as whole, o1.p, left_,
         (('0x' || substr(md5(concat('7:', coalesce(d.doc_id::varchar, '-'))), 1, 13))::bigint::double + 0.5::double) / 4503599627370496 as u
      from d join p on d.source is not distinct from p.source join o1 on d.source is not distinct from o1.source and length(bin(d.size)) = o1.bits),
k as (select *, case when p > 0 and p < 1 then u / (1 - u) / (p / (1 - p)) else u end as rank from u),
m as (select *, sum(size) over (partition by source order by rank, doc_id, size) <= left_ as fits from k where p > 0 and p < 1),
g as (select source, any_value(left_) - coalesce(sum(size) filter (fits), 0) as gap from m group by source),
o as (select m.source, m.doc_id, m.size, m.rank, row_number() over (partition by m.source order by abs(size - gap), rank, doc_id, size) as nth
      from m join g on m.source is not distinct from g.source where not fits and size > 0 and abs(size - gap) < gap),
t1 as (select doc_id, source, size, rank from m where fits union all select doc_id, source, size, rank from o where nth = 1)
select k.doc_id, k.source, k.size, k.source_size, k.target, (k.whole + case when t1.rank is not null then 1 else 0 end)::bigint as copies,
       ((k.whole + case when t1.rank is not null then 1 else 0 end) * k.size)::bigint as taken
from k left join (select distinct * from t1) t1 on k.source is not distinct from t1.source and k.doc_id is not distinct from t1.doc_id and k.size = t1.size and k.rank = t1.rank and k.p > 0 and k.p < 1
"""

ORACLES: dict[str, str] = {"op1_mix": OP1_SQL, "op11_audit": audit_sql.SQL, "op12_search": lexical_sql.SQL}
