"""Replies of models as data: parsed, checked, kept or quarantined. No row is lost: each has its reason or its items."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest import vocabulary as V
from attest.functions import text as T

ITEM = "struct<subject:string,predicate:string,object:string,sentence:string>"
CLAIM = "struct<subject:string,claim:string,polarity:string,sentence:string>"
#: Fixed values.
POLARITIES = ("POSITIVE", "NEGATIVE", "NEUTRAL")
REPLY = f"struct<triples:array<{ITEM}>,claims:array<{CLAIM}>>"

#: A string, one that doesn't end, a brace, or what lies between: together they are the whole text.
_TOKEN = r'''"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|"[\s\S]*+|[{}]|[^"{}]++'''


def _made(rows: DataFrame, value: Column) -> DataFrame:
    """Rows with a struct's fields beside them. It is made by a generator, so filters on the fields don't make it again."""
    return rows.select("*", F.inline(F.array(value)))


def json_envelope(c: Column) -> Column:
    """The first balanced object of a reply, outside strings; a code fence around it is taken off. Null if there is none."""
    inside = F.when(F.contains(c, F.lit("```")), F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, token: Column) -> Column:
        depth = a["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = a["at"] + F.length(token)
        closed = (a["end"] == 0) & (depth == 0) & (token == "}")
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(a["end"]).alias("end"))

    def first(x: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0)), zero, step)["end"]
        return T.once(end, lambda n: F.when(n > 0, F.substring(x, F.lit(1), n)))

    def unfenced(x: Column) -> Column:
        start = F.instr(x, "{")
        return T.once(F.when(start > 0, F.substring(x, start, F.length(x))), first)

    return T.once(F.when(inside != "", inside).otherwise(c), unfenced)


def _bad_fields(r: Column) -> Column:
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    triple = lambda t: blank(t["subject"]) | blank(t["object"]) | blank(t["sentence"]) | ~F.coalesce(t["predicate"].rlike("^[a-z][a-z_]{2,59}$"), F.lit(False)) | (F.length(t["subject"]) > 300) | (F.length(t["object"]) > 300) | (F.length(t["sentence"]) > 600)
    claim = lambda t: blank(t["subject"]) | blank(t["claim"]) | blank(t["sentence"]) | (F.length(t["claim"]) > 600) | (F.length(t["subject"]) > 300) | (F.length(t["sentence"]) > 600) | ~F.coalesce(t["polarity"].isin(*POLARITIES), F.lit(False))
    none = F.lit(False)
    return F.coalesce(F.exists(r["triples"], triple), none) | F.coalesce(F.exists(r["claims"], claim), none)


def reply_schema_check(replies: DataFrame) -> DataFrame:
    """Adds body (parsed) and reason: no object, unknown root keys, unreadable, or a field that breaks its rule; in this order."""
    known = F.array(F.lit("triples"), F.lit("claims"))

    def checked(json: Column, keys: Column, body: Column) -> Column:
        extra = F.size(F.array_except(keys, known)) > 0
        reason = F.when(json.isNull(), "MALFORMED_JSON").when(keys.isNull(), "MALFORMED_JSON").when(extra, "SCHEMA_VALIDATION_FAILED").when(body.isNull(), "MALFORMED_JSON").when(_bad_fields(body), "SCHEMA_VALIDATION_FAILED")
        return F.struct(json.alias("json"), body.alias("body"), reason.alias("reason"))

    parsed = lambda json: F.struct(json.alias("json"), F.json_object_keys(json).alias("keys"), F.from_json(json, REPLY).alias("body"))
    return _made(replies, T.once(T.once(json_envelope(F.col("raw_text")), parsed), lambda x: checked(x["json"], x["keys"], x["body"])))


def reply_semantic_check(items: DataFrame, chunks: DataFrame, most: int = 12) -> DataFrame:
    """Facts of replies (reply_id, chunk_id, place, subject, predicate, object, sentence) -> per reply: reason or null, and distinct facts.

    The sentence must be in the chunk, the predicate registered; any error rejects the reply.
    """
    known = [p[0] for p in V.PREDICATES]
    rows = items.join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    wrong = ~F.coalesce(T.phrase_contains(F.col("content"), F.col("sentence")), F.lit(False)) | ~F.lower("predicate").isin(known)
    fact = F.concat_ws("|", F.lower(F.trim("subject")), F.lower("predicate"), F.lower(F.trim("object")))
    out = rows.groupBy("reply_id").agg(F.count("*").alias("n_items"), F.count_if(wrong).alias("n_wrong"), F.countDistinct(fact).alias("n_distinct"))
    return out.withColumn("reason", F.when(F.col("n_items") > most, "OBJECT_LIMIT_EXCEEDED").when(F.col("n_wrong") > 0, "SEMANTIC_VALIDATION_FAILED"))


def reply_items_check(checked: DataFrame, most_triples: int = 12, most_claims: int = 8) -> DataFrame:
    """Replies of ``reply_schema_check`` with content, the text of their chunk -> reason, and the triples and claims that are kept.

    A sentence must be in the chunk and a predicate registered; any error, or more items than allowed, rejects the whole
    reply. What repeats an item before it is left out. All of it is computed in the reply's own row.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    there = lambda x: F.coalesce(T.phrase_contains(F.col("content"), x["sentence"]), F.lit(False))
    known = lambda x: x["predicate"].isin([p[0] for p in V.PREDICATES])

    def first_ones(items: Column, key) -> Column:
        keys = F.transform(items, key)
        return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)

    triples = F.coalesce("body.triples", F.array().cast(f"array<{ITEM}>"))
    claims = F.coalesce("body.claims", F.array().cast(f"array<{CLAIM}>"))
    wrong = F.exists("triples", lambda x: ~there(x) | ~known(x)) | F.exists("claims", lambda x: ~there(x))
    many = (F.size("triples") > most_triples) | (F.size("claims") > most_claims)
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(many, "OBJECT_LIMIT_EXCEEDED").when(wrong, "SEMANTIC_VALIDATION_FAILED")
    rows = checked.withColumns({"triples": triples, "claims": claims}).withColumn("reason", reason)
    kept = {"triples": first_ones(F.col("triples"), lambda x: F.concat_ws("|", norm(x["subject"]), x["predicate"], norm(x["object"]))), "claims": first_ones(F.col("claims"), lambda x: F.concat_ws("|", norm(x["subject"]), norm(x["claim"]), x["polarity"]))}
    return rows.withColumns({k: F.when(F.col("reason").isNull(), v) for k, v in kept.items()}).drop("body", "json")


def quarantine_split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter("reason is null"), checked.filter("reason is not null")


def quarantine_by_reason(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is not null").groupBy("corpus_id", "reason").agg(F.count("*").alias("n"))


def citation_validate(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """(reply_id, place, raw) -> per citation: the id, and why it is refused; repeats after the first are refused too."""
    rows = cited.withColumn("id", F.expr("try_cast(trim(raw) as bigint)")).join(allowed.select("reply_id", "id", F.lit(True).alias("ok")).distinct(), ["reply_id", "id"], "left")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("reply_id", "id").orderBy("place"))
    why = F.when(F.col("id").isNull(), "NOT_A_NUMBER").when(F.col("ok").isNull(), "NOT_IN_SET").when(nth > 1, "REPEATED")
    return rows.select("reply_id", "place", "raw", "id", why.alias("reason"))


def judge_reply_check(replies: DataFrame) -> DataFrame:
    """(reply_id, raw_text, allowed array<bigint>) -> verdict, confidence, cited and reason."""
    body = F.from_json(json_envelope(F.col("raw_text")), "struct<verdict:string,confidence:double,reasoning:string,passage_ids:array<bigint>>")
    rows = _made(replies, F.struct(body.alias("b")))
    verdict = F.upper(F.trim("b.verdict"))
    cited = F.coalesce("b.passage_ids", F.array().cast("array<bigint>"))
    why = (
        F.when(F.col("b").isNull(), "MALFORMED_JSON").when(~F.coalesce(verdict.isin("SUPPORTED", "CONTRADICTED", "EXAGGERATED", "INSUFFICIENT_EVIDENCE", "SOURCE_MISSING"), F.lit(False)), "UNKNOWN_VERDICT")
        .when(~F.coalesce(F.col("b.confidence").between(0, 1), F.lit(True)), "CONFIDENCE_OUT_OF_RANGE").when(F.length("b.reasoning") > 4000, "REASONING_TOO_LONG").when(F.size(F.array_except(cited, "allowed")) > 0, "UNKNOWN_PASSAGE")
        .when(verdict.isin("SUPPORTED", "CONTRADICTED", "EXAGGERATED") & (F.size(cited) == 0), "EVIDENCE_REQUIRED")
    )
    return rows.select("reply_id", verdict.alias("verdict"), F.col("b.confidence").alias("confidence"), cited.alias("cited"), why.alias("reason"))


def persona_reply_check(replies: DataFrame) -> DataFrame:
    """(reply_id, raw_text, allowed array<string>): an argument is needed; one refused citation fails the reply."""
    rows = _made(replies, F.struct(F.from_json(json_envelope(F.col("raw_text")), "struct<argument:string,stance:string,citations:array<string>>").alias("b")))
    cited = F.coalesce("b.citations", F.array().cast("array<string>"))
    why = F.when(F.col("b").isNull(), "MALFORMED_JSON").when(F.coalesce(F.trim("b.argument"), F.lit("")) == "", "ARGUMENT_REQUIRED").when((F.length("b.argument") > 8000) | (F.length("b.stance") > 500), "TOO_LONG").when(F.size(F.array_except(F.transform(cited, lambda x: F.trim(x)), "allowed")) > 0, "CITATION_REFUSED")
    return rows.select("reply_id", F.col("b.stance").alias("stance"), why.alias("reason"))


def synthesis_reply_check(replies: DataFrame, block_types: list[str]) -> DataFrame:
    """(reply_id, raw_text, allowed array<string>): a conclusion, blocks of known types with text, and known ids."""
    kind = "struct<conclusion:string,blocks:array<struct<type:string,text:string,argument_ids:array<string>>>>"
    rows = _made(replies, F.struct(F.from_json(json_envelope(F.col("raw_text")), kind).alias("b")))
    good = lambda x: x["type"].isin(block_types) & (F.length(x["text"]) <= 4000) & (F.size(F.array_except(F.coalesce(x["argument_ids"], F.array().cast("array<string>")), F.col("allowed"))) == 0)
    why = F.when(F.col("b").isNull(), "MALFORMED_JSON").when(F.coalesce(F.trim("b.conclusion"), F.lit("")) == "", "CONCLUSION_REQUIRED").when(F.coalesce(F.size("b.blocks"), F.lit(0)) < 1, "BLOCKS_REQUIRED").when(~F.coalesce(F.forall("b.blocks", good), F.lit(False)), "BLOCK_REFUSED")
    return rows.select("reply_id", F.size("b.blocks").alias("n_blocks"), why.alias("reason"))


def chat_reply_check(replies: DataFrame) -> DataFrame:
    """(reply_id, raw_text, allowed array<bigint>): an answer is needed and ids must be supplied ones; evidence is enough by default."""
    rows = _made(replies, F.struct(F.from_json(json_envelope(F.col("raw_text")), "struct<answer:string,passage_ids:array<bigint>,sufficient_evidence:boolean>").alias("b")))
    cited = F.coalesce("b.passage_ids", F.array().cast("array<bigint>"))
    why = F.when(F.col("b").isNull(), "MALFORMED_JSON").when(F.coalesce(F.trim("b.answer"), F.lit("")) == "", "ANSWER_REQUIRED").when(F.length("b.answer") > 8000, "TOO_LONG").when(F.size(F.array_except(cited, "allowed")) > 0, "UNKNOWN_PASSAGE")
    return rows.select("reply_id", F.coalesce("b.sufficient_evidence", F.lit(True)).alias("sufficient"), why.alias("reason"))
