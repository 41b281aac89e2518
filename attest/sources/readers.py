"""Reading documents and gold data; a rejected input comes back as rows with a reason."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest import vocabulary as V
from attest.functions import text as T
from attest.operators.documents import gate


def text_docs(spark: SparkSession, path: str, corpus_id: int = 1) -> DataFrame:
    """Text files, one document each: title and safe file name from the path, and why it is rejected if it is."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    name = T.safe_filename(F.url_decode(F.element_at(F.split("path", "/"), -1)))
    rows = rows.select(F.lit(corpus_id).cast("long").alias("corpus_id"), T.title_of(name).alias("title"), name.alias("original_filename"), "text")
    return gate(rows, 5_000_000)


def gold_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``query = chunk id`` -> line_no, query, gold_chunk_id, error. The last = counts; blank lines and # are skipped."""
    return parsed_gold(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def parsed_gold(files: DataFrame) -> DataFrame:
    """The same for whole files in column text."""
    lines = files.select(F.posexplode(F.split("text", "\r?\n")).alias("no", "line")).filter("trim(line) <> '' and not trim(line) like '#%'")
    rows = lines.select((F.col("no") + 1).alias("line_no"), F.trim(F.regexp_extract("line", "^(.*)=([^=]*)$", 1)).alias("query"), F.expr("try_cast(trim(regexp_extract(line, '^(.*)=([^=]*)$', 2)) as bigint)").alias("gold_chunk_id"), F.contains("line", F.lit("=")).alias("has"))
    key = F.lower(F.regexp_replace("query", r"\s+", " "))
    again = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) > 1
    error = F.when(~F.col("has"), "NO_EQUALS_SIGN").when(F.col("gold_chunk_id").isNull(), "NOT_A_NUMBER").when((F.col("query") == "") | (F.length("query") > 500), "BAD_QUERY").when(again, "REPEATED_QUERY")
    return rows.select("line_no", "query", "gold_chunk_id", error.alias("error"))


def gold_extraction(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated document, subject, predicate, object, sentence, with an error for unknown predicates and short rows."""
    kind = "document string, subject string, predicate string, object string, sentence string"
    rows = spark.read.schema(kind).csv(path, sep="\t", comment="#", quote="")
    known = F.lower("predicate").isin([p[0] for p in V.PREDICATES])
    return rows.withColumn("error", F.when(F.col("sentence").isNull(), "TOO_FEW_COLUMNS").when(~known, "UNKNOWN_PREDICATE"))


PROSE = "documents array<struct<document:string,sentences:array<struct<text:string,expectNothing:boolean,triples:array<struct<subject:string,predicate:string,object:string>>,claims:array<struct<subject:string,polarity:string>>>>>>"


def gold_prose(spark: SparkSession, path: str) -> DataFrame:
    """Nested gold -> a row per sentence with its labels, and whether one is unknown."""
    rows = spark.read.schema(PROSE).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.document", F.posexplode("d.sentences").alias("no", "s"))
    known = [p[0] for p in V.PREDICATES]
    bad = F.coalesce(F.exists("s.triples", lambda t: ~F.lower(t["predicate"]).isin(known)), F.lit(False)) | F.coalesce(F.exists("s.claims", lambda c: ~c["polarity"].isin("POSITIVE", "NEGATIVE", "NEUTRAL")), F.lit(False))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.select("document", "no", F.col("s.text").alias("sentence"), F.greatest(n("s.triples"), F.lit(0)).alias("n_triples"), F.greatest(n("s.claims"), F.lit(0)).alias("n_claims"), F.coalesce("s.expectNothing", F.lit(False)).alias("expect_nothing"), bad.alias("bad"))


def gold_verdicts(spark: SparkSession, path: str) -> DataFrame:
    kind = "items array<struct<id:string,claimText:string,expectedVerdict:string,category:string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("items").alias("i"))
    return rows.select("i.id", F.col("i.claimText").alias("text"), F.col("i.expectedVerdict").alias("expected"), "i.category")


REPLIES = "corpus_id long, reply_id long, raw_text string, broken string"


def model_replies(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of raw replies -> corpus_id, reply_id, raw_text, broken; none is lost.

    A line that is no such record keeps its text in broken and in raw_text, and gets corpus 0 and an id from the text, so
    that it can be quarantined like a reply. path: files or a folder; as a stream, the files that come into it.
    """
    reader = (spark.readStream if stream else spark.read).schema(REPLIES)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    bad = F.col("broken").isNotNull() | F.col("corpus_id").isNull() | F.col("reply_id").isNull()
    text = F.coalesce("broken", F.to_json(F.struct("corpus_id", "reply_id", "raw_text")))
    own = -F.abs(F.pmod(F.xxhash64(text), F.lit(2**62))) - 1
    return rows.select(F.when(bad, F.lit(0).cast("long")).otherwise(F.col("corpus_id")).alias("corpus_id"), F.when(bad, own).otherwise(F.col("reply_id")).alias("reply_id"), F.when(bad, text).otherwise(F.coalesce("raw_text", F.lit(""))).alias("raw_text"), F.when(bad, text).alias("broken"))
