"""Documents: duplicates, sentences, overlapping chunks and a rule extractor."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest import vocabulary as V
from attest.functions import text as T

_DOT = "\ue000"  # private use: not in any text
_SENTENCE = r"(?s)[^.!?。！？]*[.!?。！？][\"')\]”’）]*|[^.!?。！？]+"


def doc_dedup(docs: DataFrame) -> DataFrame:
    """Every document with the first (least id) of its corpus that has the same text."""
    keyed = docs.withColumn("content_hash", T.sha256_hex(F.col("text")))
    first = keyed.groupBy("corpus_id", "content_hash").agg(F.min("doc_id").alias("kept_id"))
    return keyed.join(first, ["corpus_id", "content_hash"]).select("doc_id", "corpus_id", "content_hash", "kept_id", (F.col("doc_id") != F.col("kept_id")).alias("is_repeat"))


def gate(docs: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Adds why a document is rejected, null if it isn't."""
    n = F.length(F.coalesce("text", F.lit("")))
    return docs.withColumn("reason", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "EMPTY").when(n > most, "TOO_LONG"))


def sentences(c: Column) -> Column:
    """Sentences of a normalized text, with the white space before them; joined they are the text.

    A dot between digits, after a listed abbreviation or after a single capital letter ends none: it is
    replaced by a character of the same length while the text is cut.
    """
    x = F.regexp_replace(c, r"(?<=\p{Nd})\.(?=\p{Nd})", _DOT)
    x = F.regexp_replace(x, rf"(?i)(?<!\p{{L}})({'|'.join(V.ABBREVIATIONS)})\.", f"$1{_DOT}")
    x = F.regexp_replace(x, r"(?<!\p{L})(\p{Lu})\.", f"$1{_DOT}")
    return F.transform(F.regexp_extract_all(x, F.lit(_SENTENCE), 0), lambda s: F.translate(s, _DOT, "."))


def sentence_split(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, sentence_no, start_offset, end_offset, sentence), blank ones dropped; offsets in code points."""
    parts = docs.select("doc_id", F.posexplode(sentences(T.normalize(F.col("text")))).alias("no", "sentence"))
    before = Window.partitionBy("doc_id").orderBy("no")
    end = F.sum(F.length("sentence")).over(before)
    rows = parts.withColumns({"end_offset": end, "start_offset": end - F.length("sentence")}).filter(r"sentence rlike '\\S'")
    return rows.select("doc_id", (F.row_number().over(before) - 1).alias("sentence_no"), "start_offset", "end_offset", "sentence")


def chunk_overlap(docs: DataFrame, target: int = 300, overlap: int = 50, chars_per_token: int = 4) -> DataFrame:
    """(doc_id, text) -> chunks of whole sentences with overlap: chunk_index, content, start_offset, end_offset, token_estimate.

    For every sentence a range window says where a chunk that begins there ends and where the next one
    begins; then one pass per document follows these from the first sentence on.
    """
    text = docs.select("doc_id", T.normalize(F.col("text")).alias("text"))
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("sentence_no")
    s = sentence_split(docs).withColumn("len", F.col("end_offset") - F.col("start_offset"))
    s = s.withColumns({"pre": F.sum("len").over(order) - F.col("len"), "total": F.sum("len").over(doc), "n": F.count("*").over(doc), "tok": F.ceil(F.col("len") / chars_per_token).cast("long")})
    s = s.withColumns({"at": F.col("pre") + F.col("sentence_no"), "tok_before": F.sum("tok").over(order) - F.col("tok"), "all_tok": F.sum("tok").over(doc)})
    room = target * chars_per_token + 1
    reach = F.max("sentence_no").over(doc.orderBy("at").rangeBetween(0, room))
    stop = F.greatest(F.col("sentence_no") + 1, F.when(F.col("total") + F.col("n") <= F.col("at") + room, F.col("n")).otherwise(reach))
    back = F.coalesce(F.min("sentence_no").over(doc.orderBy("tok_before").rangeBetween(-overlap, -1)), F.col("sentence_no") - 1)
    last = F.coalesce(F.min(F.when(F.col("tok_before") >= F.col("all_tok") - overlap, F.col("sentence_no"))).over(doc), F.col("n") - 1)
    s = s.withColumns({"stop": stop.cast("int"), "back": back.cast("int"), "last": last.cast("int")})
    rows = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "start_offset", "end_offset", "stop", "back"))).alias("s"), F.first("n").cast("int").alias("n"), F.first("last").alias("last"))

    def follow(starts: Column, _: Column) -> Column:
        at = F.element_at(starts, -1)
        to = F.get(F.col("s"), at)["stop"]
        then = F.greatest(at + 1, F.when(to >= F.col("n"), F.col("last")).otherwise(F.get(F.col("s"), to)["back"])).cast("int")
        return F.when(at >= F.col("n"), starts).otherwise(F.concat(starts, F.array(F.coalesce(then, F.col("n")))))

    starts = F.filter(F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.lit(0)), follow), lambda x: x < F.col("n"))
    cut = F.transform(starts, lambda i: F.struct(F.get(F.col("s"), i)["start_offset"].alias("a"), F.get(F.col("s"), F.get(F.col("s"), i)["stop"] - 1)["end_offset"].alias("b")))
    chunks = rows.select("doc_id", F.posexplode(cut).alias("chunk_index", "span")).join(text, "doc_id")
    raw = F.substring(F.col("text"), F.col("span.a") + 1, F.col("span.b") - F.col("span.a"))
    left = F.length(raw) - F.length(F.regexp_replace(raw, r"\A\s+", ""))
    content = F.regexp_replace(raw, r"\A\s+|\s+\z", "")
    out = chunks.select("doc_id", "chunk_index", content.alias("content"), (F.col("span.a") + left).cast("int").alias("start_offset"))
    return out.withColumns({"end_offset": F.col("start_offset") + F.length("content"), "token_estimate": T.token_estimate(F.col("content"), chars_per_token)})


def chunk_content(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each chunk again, from its document and offsets."""
    text = docs.select("doc_id", T.normalize(F.col("text")).alias("text"))
    return chunks.join(text, "doc_id").select("doc_id", "chunk_index", F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")).alias("content"))


def extract_spo(chunks: DataFrame, most: int = 8) -> DataFrame:
    """(chunk_id, content) -> facts and claims of sentences that read ``Subject predicate Object``.

    At most eight of each for a chunk; sentences after the one with the eighth fact give nothing.
    """
    names = [p[0] for p in V.PREDICATES]
    parts = chunks.select("chunk_id", F.posexplode(F.split("content", r"(?<=[.!?])\s+")).alias("no", "sentence")).withColumn("sentence", F.trim("sentence")).filter(F.length("sentence") > 15)
    parts = parts.withColumn("words", F.split("sentence", r"\s+"))
    plain = F.transform("words", lambda w: F.regexp_replace(F.lower(w), "[^a-z_]", ""))
    inner = F.transform(plain, lambda w, i: F.when((i >= 1) & (i < F.size("words") - 1) & w.isin(names), i))
    at = F.array_min(F.array_compact(inner))
    parts = parts.withColumns({"at": at, "predicate": F.get(plain, at)})
    after = F.array_join(F.slice("words", F.col("at") + 2, F.size("words")), " ")
    obj = F.when(F.instr(after, ".") > 1, F.substring_index(after, ".", 1)).otherwise(after)
    parts = parts.withColumns({"subject": F.array_join(F.slice("words", 1, F.col("at")), " "), "object": obj})
    order = Window.partitionBy("chunk_id").orderBy("no")
    is_fact = F.coalesce((F.col("at").isNotNull()) & (F.trim("object") != ""), F.lit(False))
    parts = parts.withColumn("nth_fact", F.sum(is_fact.cast("int")).over(order)).withColumn("is_fact", is_fact)
    open_ = parts.filter(F.col("nth_fact") - F.col("is_fact").cast("int") < most)
    facts = open_.filter("is_fact").select("chunk_id", F.lit("TRIPLE").alias("kind"), "subject", "predicate", F.col("object").alias("object_or_claim"), "sentence")
    claims = open_.filter(F.length("sentence") > 25).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    claims = claims.select("chunk_id", F.lit("CLAIM").alias("kind"), F.get("words", F.lit(0)).alias("subject"), F.lit("NEUTRAL").alias("predicate"), F.col("sentence").alias("object_or_claim"), "sentence")
    return facts.unionByName(claims)
