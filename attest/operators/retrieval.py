"""Ranking chunks for questions: postings in blocks with their largest scores, blocks that can't matter left out, the best kept by a window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import text as T
from attest.operators._store import saved

#: Chunks of a block, in the mean, and blocks of a query that are scored for its threshold.
BLOCK, SEEDS = 256, 2


def index_terms(chunks: DataFrame) -> DataFrame:
    """(corpus_id, chunk_id, content) -> (corpus_id, chunk_id, term, tf): words of letters, digits and _, three or more."""
    words = F.filter(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]+"), 0), lambda w: F.length(w) >= 3)
    return chunks.select("corpus_id", "chunk_id", F.explode(words).alias("term")).groupBy("corpus_id", "chunk_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, expand: bool = True) -> DataFrame:
    terms = T.once(T.query_tokens(F.col("query_text")), T.search_terms if expand else F.array_distinct)
    return queries.select("corpus_id", "query_id", F.explode(terms).alias("term"))


def _postings(queries: DataFrame, chunks: DataFrame, expand: bool) -> tuple[DataFrame, DataFrame]:
    """(corpus_id, query_id, term), and the postings of these terms only with df and n_chunks of the corpus."""
    asked = saved(query_terms(queries, expand), "asked")
    words = index_terms(chunks).join(asked.select("corpus_id", "term").distinct(), ["corpus_id", "term"], "left_semi")
    n = chunks.groupBy("corpus_id").agg(F.count("*").alias("n_chunks"))
    words = saved(words, "postings")
    df = words.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
    return asked, words.join(df, ["corpus_id", "term"]).join(n, "corpus_id")


def block_lists(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Postings (corpus_id, term, chunk_id, n_chunks, part) -> a row for each term and block of chunks: its postings and the largest part.

    A block holds about so many chunks of a corpus, so no row grows with how frequent a term is.
    """
    of = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n_chunks") / block)).cast("long")
    return saved(parts.groupBy("corpus_id", "term", of.alias("block")).agg(F.max("part").alias("most"), F.collect_list(F.struct("chunk_id", "part")).alias("list")), "blocks")


def _scored(blocks: DataFrame, asked: DataFrame, lists: DataFrame) -> DataFrame:
    """(corpus_id, query_id, block) -> scores of all chunks there that have a term of the query; rounded, so the order of summing doesn't show."""
    hits = blocks.join(asked, ["corpus_id", "query_id"]).join(lists, ["corpus_id", "term", "block"])
    each = hits.select("corpus_id", "query_id", F.explode("list").alias("x"))
    return each.groupBy("corpus_id", "query_id", "x.chunk_id").agg(F.round(F.sum("x.part"), 6).alias("score"))


def best_of_blocks(asked: DataFrame, parts: DataFrame, k: int, least: float, block: int = BLOCK, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The k best chunks of each query, exactly; with them all (query, block) that hold a term, and those that were looked into.

    A block's chunks score no more than the sum of the largest parts of the query's terms there. The blocks of greatest
    bound are scored first, as many as seeds; the k-th score among their chunks is a threshold that the query's k best
    all reach. Blocks whose bound is below it are left out, the others are scored.
    """
    keys = ["corpus_id", "query_id"]
    lists = block_lists(parts, block)
    bound = saved(asked.join(lists.drop("list"), ["corpus_id", "term"]).groupBy(*keys, "block").agg(F.sum("most").alias("bound")), "bounds")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bound"), "block"))
    first = bound.withColumn("nth", nth).filter(F.col("nth") <= seeds).select(*keys, "block")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))
    reach = _scored(first, asked, lists).withColumn("nth", nth).filter(F.col("nth") == k).select(*keys, F.col("score").alias("reach"))
    # Scores are rounded to six places.
    left = saved(bound.join(saved(reach, "thresholds"), keys, "left").filter("bound + 1e-6 >= coalesce(reach, 0)").select(*keys, "block"), "left-blocks")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    best = _scored(left, asked, lists).filter(F.col("score") > least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best, bound, left


def shared_queries(asked: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which query stands for each (query_id, of), and the terms of those that do (corpus_id, query_id, term): one for each set of terms that have postings."""
    known = words.select("corpus_id", "term").distinct()
    sets = saved(asked.join(known, ["corpus_id", "term"], "left_semi").groupBy("corpus_id", "query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "term-sets")
    first = saved(sets.groupBy("corpus_id", "terms").agg(F.min("query_id").alias("of")), "shared-queries")
    terms = saved(first.select("corpus_id", F.col("of").alias("query_id"), F.explode("terms").alias("term")), "shared-terms")
    return sets.join(first, ["corpus_id", "terms"]).select("corpus_id", "query_id", "of"), terms


def _weighed(words: DataFrame) -> DataFrame:
    """Postings with what each adds to a score: tf x idf squared."""
    idf = F.log10(F.col("n_chunks") / F.col("df"))
    return words.withColumn("part", F.col("tf") * idf * idf)


def retrieve_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, least: float = 0.0, expand: bool = True) -> DataFrame:
    """The k best chunks of the query's own corpus: sum of tf x idf squared, idf = log10(chunks / chunks with the term).

    A term that all chunks have adds nothing, so it is not scored where a score has to be above 0. Queries that ask for
    the same terms of a corpus, as many claims do, are ranked once.
    """
    asked, words = _postings(queries, chunks, expand)
    words = _weighed(words)
    words = words.filter("part > 0") if least >= 0 else words
    of, terms = shared_queries(asked, words)
    best = saved(best_of_blocks(terms, words, k, least)[0].withColumnRenamed("query_id", "of"), "shared-best")
    return of.join(best, ["corpus_id", "of"]).drop("of")


def retrieve_any(queries: DataFrame, chunks: DataFrame, expand: bool = True) -> DataFrame:
    """(corpus_id, query_id) for which ``retrieve_topk`` finds a chunk, without ranking any.

    A score is no less than its largest part, so a term whose largest part rounds to more than 0 is enough. Queries that
    have none, but parts that may add up to more than 0 after rounding, are ranked.
    """
    keys = ["corpus_id", "query_id"]
    asked, words = _postings(queries, chunks, expand)
    most = saved(_weighed(words).groupBy("corpus_id", "term").agg(F.max("part").alias("most")).filter("most > 0"), "largest-parts")
    reach = saved(asked.join(most, ["corpus_id", "term"]).groupBy(*keys).agg(F.max("most").alias("least"), F.sum("most").alias("bound")), "reach")
    found, rest = reach.filter("round(least, 6) > 0").select(*keys), reach.filter("round(least, 6) = 0 and bound > 4e-7")
    if rest.isEmpty():
        return found
    return found.unionByName(retrieve_topk(queries.join(rest, keys, "left_semi"), chunks, 1, expand=expand).select(*keys))


def retrieve_bm25(queries: DataFrame, chunks: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, expand: bool = True) -> DataFrame:
    sizes = saved(index_terms(chunks).groupBy("corpus_id", "chunk_id").agg(F.sum("tf").alias("len")), "lengths")
    mean = sizes.groupBy("corpus_id").agg(F.avg("len").alias("mean_len"))
    asked, words = _postings(queries, chunks, expand)
    rows = words.join(sizes, ["corpus_id", "chunk_id"]).join(mean, "corpus_id")
    idf = F.ln(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return best_of_blocks(asked, rows.withColumn("part", part), k, 0.0)[0]


def retrieve_diagnose(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Per query: the full-text query, how many passages were kept, and why there are none."""
    kept = found.groupBy("corpus_id", "query_id").agg(F.count("*").alias("n_kept"), F.max("score").alias("best_score"))
    tokens = T.query_tokens(F.col("query_text"))
    out = queries.join(kept, ["corpus_id", "query_id"], "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    reason = F.when(F.size(tokens) == 0, "query contained no searchable keywords after normalisation").when(F.col("n_kept") == 0, "no chunk in this corpus matched the query terms")
    return out.select("corpus_id", "query_id", T.expanded_query(tokens).alias("fulltext_query"), "n_kept", "best_score", reason.alias("reason"))


def evidence_status(queries: DataFrame, found: DataFrame) -> DataFrame:
    has = found.select("corpus_id", "query_id", F.lit(True).alias("has")).distinct()
    out = queries.join(has, ["corpus_id", "query_id"], "left")
    return out.select("corpus_id", "query_id", F.when(F.col("has"), "EVIDENCE_FOUND").otherwise("NO_EVIDENCE").alias("evidence"))


def chat_names(questions: DataFrame, triples: DataFrame) -> DataFrame:
    """Per question: subjects and objects of its corpus's approved triples that have the whole question in them.

    A question begins with its first three characters, or all it has. Where a name has such a beginning, the run of each
    length that questions of this beginning have is taken and looked up among the questions, so names and questions
    that share a beginning only are never paired. An empty question finds nothing.
    """
    asked = questions.select("corpus_id", "question_id", F.lower(F.trim("question")).alias("q")).filter(F.length("q") > 0)
    begins = saved(asked.select("corpus_id", F.substring("q", 1, 3).alias("run"), F.length("q").alias("n")).distinct(), "beginnings")
    sizes = begins.groupBy("corpus_id").agg(F.collect_set(F.length("run")).alias("sizes"))
    names = triples.filter("status = 'APPROVED'").select("corpus_id", F.explode(F.array("subject_text", "object_text")).alias("name")).distinct()
    low = F.lower("name")
    each = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.transform("sizes", lambda n: F.struct(i.alias("at"), F.substr(low, i, n).alias("run"))))
    places = names.filter(F.length("name") > 0).join(sizes, "corpus_id").select("corpus_id", "name", F.inline(F.flatten(each)))
    runs = places.join(begins, ["corpus_id", "run"]).select("corpus_id", "name", F.substr(low, F.col("at"), F.col("n")).alias("q"))
    return runs.distinct().join(asked, ["corpus_id", "q"]).select("corpus_id", "question_id", "name")


def chat_triples(questions: DataFrame, triples: DataFrame, most: int = 20) -> DataFrame:
    """Per question: approved triples of its corpus whose subject or object has the whole question in it, the newest first."""
    hits = saved(chat_names(questions, triples), "question-names")
    facts = triples.filter("status = 'APPROVED'").select("corpus_id", "triple_id", F.explode(F.array_distinct(F.array("subject_text", "object_text"))).alias("name"))
    found = hits.join(facts, ["corpus_id", "name"]).select("corpus_id", "question_id", "triple_id").distinct()
    order = Window.partitionBy("corpus_id", "question_id").orderBy(F.desc("triple_id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def chat_verdicts(questions: DataFrame, verdicts: DataFrame, newest: int = 25, most: int = 8) -> DataFrame:
    """Per question: of the corpus's newest verdicts those whose subject, or a word of four letters or more, occurs in it."""
    nth = F.row_number().over(Window.partitionBy("corpus_id").orderBy(F.desc("claim_id")))
    recent = verdicts.withColumn("nth", nth).filter(F.col("nth") <= newest).select("corpus_id", "claim_id", "subject", "claim_text")
    both = questions.join(recent, "corpus_id").withColumn("q", F.lower("question"))
    words = F.filter(F.split(T.norm_label(F.col("claim_text")), " "), lambda w: F.length(w) >= 4)
    hit = both.filter(F.contains("q", F.lower("subject")) | F.exists(words, lambda w: F.contains(F.col("q"), w)))
    order = Window.partitionBy("corpus_id", "question_id").orderBy(F.desc("claim_id"))
    return hit.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("corpus_id", "question_id", "claim_id", "place")


def chat_refused(questions: DataFrame, passages: DataFrame, triples: DataFrame) -> DataFrame:
    """Questions with neither passages nor triples, or names of triples."""
    keys = ["corpus_id", "question_id"]
    return questions.join(passages.select(*keys), keys, "left_anti").join(triples.select(*keys), keys, "left_anti").select(*keys)
