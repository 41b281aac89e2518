"""Statistics and views over traces, debates, chats, jobs and listings."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.operators._store import saved
from attest.operators.ranks import numbered


def status_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def corpus_statistics(corpora: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Counts by corpus, table and status, zero where there are none, and TOTAL of each table, of any status.

    tables: name -> (rows with corpus_id and status, all statuses).
    """
    wanted = [(t, s) for t, (_, states) in tables.items() for s in (*states, "TOTAL")]
    dim = corpora.select("corpus_id", F.explode(F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(s).alias("status")) for t, s in wanted))).alias("d")).select("corpus_id", "d.*")
    parts = [df.groupBy("corpus_id", "status").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(t)) for t, (df, _) in tables.items()]
    counts = reduce(DataFrame.unionByName, parts)
    totals = counts.groupBy("corpus_id", "table_name").agg(F.sum("n").alias("n")).withColumn("status", F.lit("TOTAL"))
    counts = counts.unionByName(totals)
    return dim.join(counts, ["corpus_id", "table_name", "status"], "left").fillna(0, ["n"])


def status_rollup(df: DataFrame) -> DataFrame:
    """Counts by corpus and status with subtotals and the total, in one pass; level 0 is a cell, 1 a corpus, 3 all."""
    return df.rollup("corpus_id", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def doc_progress(docs: DataFrame, chunks: DataFrame, runs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Per document: chunks, its latest run (largest id) and quarantined replies."""
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    r = runs.groupBy("doc_id").agg(F.max_by(F.struct("run_id", "status"), "run_id").alias("r")).select("doc_id", F.col("r.run_id").alias("run_id"), F.col("r.status").alias("run_status"))
    q = quarantine.groupBy("doc_id").agg(F.count("*").alias("n_quarantined"))
    return docs.join(c, "doc_id", "left").join(r, "doc_id", "left").join(q, "doc_id", "left").fillna(0, ["n_chunks", "n_quarantined"])


def system_status(jobs: DataFrame, states: list[str]) -> DataFrame:
    """One row: jobs in each state."""
    return jobs.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in states), F.count("*").alias("total"))


def system_overview(jobs: DataFrame, states: list[str], users: DataFrame) -> DataFrame:
    """One row: jobs in each state, and users. Both are counted in one pass over what each contributes."""
    counted = users.select(F.lit(None).cast("string").alias("status"), F.lit(1).alias("is_user"))
    rows = jobs.select("status", F.lit(0).alias("is_user")).unionByName(counted)
    return rows.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in states), F.count_if(F.col("is_user") == 0).alias("total"), F.count_if(F.col("is_user") == 1).alias("n_users"))


def trace_run_summary(steps: DataFrame) -> DataFrame:
    """Per run: steps, and the kinds of actors in fixed order joined by +."""
    kinds = F.array(*map(F.lit, ("ENGINE", "LLM", "HUMAN")))
    out = steps.groupBy("run_id").agg(F.count("*").alias("n_steps"), F.collect_set("actor_type").alias("k"))
    return out.select("run_id", "n_steps", F.array_join(F.filter(kinds, lambda x: F.array_contains("k", x)), "+").alias("actors"))


def trace_replay(steps: DataFrame) -> DataFrame:
    """Steps of each run in order, with their children's ids as text."""
    kids = steps.filter("parent_step_id is not null").groupBy(F.col("parent_step_id").alias("step_id")).agg(F.array_join(F.sort_array(F.collect_list("step_id")), ",").alias("children"))
    return steps.join(kids, "step_id", "left").select("run_id", "seq", "step_id", F.coalesce("children", F.lit("")).alias("children"))


def trace_xray(steps: DataFrame) -> DataFrame:
    """Each step's place in its actor's lane."""
    lane = Window.partitionBy("run_id", "actor_type").orderBy("seq")
    return steps.select("run_id", "actor_type", "seq", F.row_number().over(lane).alias("lane_no"))


def trace_seq_check(steps: DataFrame) -> DataFrame:
    """Per run: the last number, and gaps and repeats before it."""
    order = Window.partitionBy("run_id").orderBy("seq", "step_id")
    gap = F.col("seq") - F.coalesce(F.lag("seq").over(order), F.lit(0))
    return steps.withColumn("gap", gap).groupBy("run_id").agg(F.max("seq").alias("step_seq"), F.count_if(F.col("gap") > 1).alias("gaps"), F.count_if(F.col("gap") == 0).alias("repeats"))


def trace_duration(steps: DataFrame) -> DataFrame:
    """Per run: days from first to last step, retries, most attempts."""
    return steps.groupBy("run_id").agg(F.datediff(F.max("happened_on"), F.min("happened_on")).alias("days"), F.count_if(F.col("status") == "RETRYING").alias("retries"), F.max("attempt").alias("most_attempts"))


def trace_duration_ms(steps: DataFrame) -> DataFrame:
    """Per run, from steps with a time (at): milliseconds from first to last, retries, most attempts of a step."""
    took = F.floor((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1000)
    return steps.groupBy("run_id").agg(took.alias("duration_ms"), F.count_if(F.col("status") == "RETRYING").alias("n_retries"), F.max("attempt").alias("max_attempt"))


def trace_retention(steps: DataFrame, before: Column) -> DataFrame:
    """Steps of runs that have one on or after a date."""
    live = steps.groupBy("run_id").agg(F.min("happened_on").alias("started")).filter(F.col("started") >= before)
    return steps.join(live.select("run_id"), "run_id", "left_semi")


def latest_weight(weights: DataFrame) -> DataFrame:
    """Weights are only ever added; the last one of an argument counts."""
    return weights.groupBy("argument_id").agg(F.max_by("weight", "weight_id").alias("weight"), F.max("weight_id").alias("weight_id"), F.count("*").alias("n_weights"))


def weight_validate(weights: DataFrame, arguments: DataFrame) -> DataFrame:
    """Weights with why they are refused, null if they aren't."""
    rows = weights.join(arguments.select("argument_id", "failed"), "argument_id", "left")
    why = F.when(F.col("failed").isNull(), "UNKNOWN_ARGUMENT").when(F.col("failed"), "FAILED_ARGUMENT").when(~F.col("weight").between(1, 5), "OUT_OF_RANGE")
    return rows.select("weight_id", "argument_id", "weight", why.alias("reason"))


def unweighted_args(arguments: DataFrame, weights: DataFrame) -> DataFrame:
    """Arguments that still hold up their round: not failed, without any weight."""
    return arguments.filter(~F.col("failed")).join(weights.select("argument_id"), "argument_id", "left_anti")


def debate_view(debates: DataFrame, arguments: DataFrame, weights: DataFrame, citations: DataFrame) -> DataFrame:
    """Debates with nested rounds, their arguments (with the last weight and who gave it) and what those cite.

    citations: argument_id, place and source_id. A debate without arguments has no rounds (null).
    """
    last = weights.groupBy("argument_id").agg(F.max_by(F.struct("weight", "verifier_id"), "weight_id").alias("w"))
    cited = citations.groupBy("argument_id").agg(F.array_sort(F.collect_list(F.struct("place", "source_id"))).alias("citations"))
    a = arguments.join(last, "argument_id", "left").join(cited, "argument_id", "left")
    row = F.struct("argument_id", "persona", "failed", F.col("w.weight").alias("weight"), F.col("w.verifier_id").alias("weighter"), F.coalesce(F.transform("citations", lambda c: c["source_id"]), F.array().cast("array<bigint>")).alias("citations"))
    rounds = a.groupBy("debate_id", "round_id", "round_number").agg(F.array_sort(F.collect_list(row)).alias("arguments"))
    nested = rounds.groupBy("debate_id").agg(F.array_sort(F.collect_list(F.struct("round_number", "round_id", "arguments"))).alias("rounds"))
    return debates.join(nested, "debate_id", "left")


def round_outcome(arguments: DataFrame) -> DataFrame:
    """Per round: arguments that hold and that failed, and who made those that hold."""
    held = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("failed"), F.col("persona")))), "+")
    return arguments.groupBy("debate_id", "round_id").agg(F.count_if(~F.col("failed")).alias("completed"), F.count_if("failed").alias("failed"), held.alias("personas"))


#: (state, event) -> state; the round ceiling decides where weights lead.
DEBATE_MOVES = [("CREATED", "START", "ROUND_ACTIVE"), ("ROUND_ACTIVE", "ARGUED", "AWAITING_CHAIR"), ("AWAITING_CHAIR", "WEIGHTS", "ROUND_ACTIVE"), ("SYNTHESIZING", "DONE", "COMPLETED"), *((s, "ABORT", "ABORTED") for s in ("CREATED", "ROUND_ACTIVE", "AWAITING_CHAIR", "SYNTHESIZING"))]


def debate_fsm(events: DataFrame, most_rounds: int = 3) -> DataFrame:
    """(debate_id, at, event_id, event) -> state, round and refused events after all of them, folded in order per debate."""
    table = F.create_map(*(F.lit(x) for a, e, b in DEBATE_MOVES for x in (f"{a}>{e}", b)))
    start = F.struct(F.lit("CREATED").alias("state"), F.lit(0).alias("round"), F.lit(0).alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        to = F.element_at(table, F.concat(acc["state"], F.lit(">"), e["event"]))
        ends = (acc["state"] == "AWAITING_CHAIR") & (e["event"] == "WEIGHTS") & (acc["round"] >= most_rounds)
        state = F.when(ends, "SYNTHESIZING").otherwise(F.coalesce(to, acc["state"]))
        return F.struct(state.alias("state"), (acc["round"] + F.when((state == "ROUND_ACTIVE") & (acc["state"] != "ROUND_ACTIVE"), 1).otherwise(0)).alias("round"), (acc["refused"] + F.when(to.isNull(), 1).otherwise(0)).alias("refused"))

    log = events.groupBy("debate_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "event"))).alias("log"))
    return log.select("debate_id", F.aggregate("log", start, step).alias("end")).select("debate_id", "end.*")


def debate_refusals(events: DataFrame, most_rounds: int = 3) -> DataFrame:
    """(debate_id, at, event_id, event) -> the events that a debate's state did not allow, with that state and its round."""
    table = F.create_map(*(F.lit(x) for a, e, b in DEBATE_MOVES for x in (f"{a}>{e}", b)))
    start = F.struct(F.lit("CREATED").alias("state"), F.lit(0).alias("round"), F.array().cast("array<struct<event_id:bigint,state:string,round:int>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        to = F.element_at(table, F.concat(acc["state"], F.lit(">"), e["event"]))
        ends = (acc["state"] == "AWAITING_CHAIR") & (e["event"] == "WEIGHTS") & (acc["round"] >= most_rounds)
        state = F.when(ends, "SYNTHESIZING").otherwise(F.coalesce(to, acc["state"]))
        number = acc["round"] + F.when((state == "ROUND_ACTIVE") & (acc["state"] != "ROUND_ACTIVE"), 1).otherwise(0)
        refused = F.array(F.struct(e["event_id"].cast("long").alias("event_id"), acc["state"].alias("state"), acc["round"].alias("round")))
        return F.struct(state.alias("state"), number.alias("round"), F.when(to.isNull(), F.concat(acc["out"], refused)).otherwise(acc["out"]).alias("out"))

    log = events.groupBy("debate_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "event"))).alias("log"))
    return log.select("debate_id", F.explode(F.aggregate("log", start, step)["out"]).alias("x")).select("debate_id", "x.*")


def _fact(kind: str, number: Column, category: str, line: Column) -> Column:
    return F.struct(F.concat(F.lit(f"{kind}-"), number.cast("string")).alias("fact_id"), F.lit(category).alias("category"), line.alias("line"))


def conflict_facts(conflicts: DataFrame, claims: DataFrame, verdicts: DataFrame, triples: DataFrame, most: int = 10) -> DataFrame:
    """(corpus_id, conflict_hash, facts) with the facts (fact_id, category, line) of every contradiction in an array.

    VD- verdicts of the claims in conflict and of the first few claims on the same subject, TR- the triples in
    conflict, GAP- what is missing. Lines on a subject are gathered before its conflicts get them, so what a conflict has
    is not shuffled line by line, and an id that a conflict has is not taken again from its subject. claims: approved ones.
    """
    keys = ["corpus_id", "conflict_hash"]
    verdict = verdicts.select("corpus_id", F.lit(True).alias("vd"), F.col("claim_id").alias("id"), F.concat_ws(" ", "subject", "predicate", "object_text", F.lit("->"), "verdict").alias("line"))
    triple = triples.select("corpus_id", F.lit(False).alias("vd"), F.col("triple_id").alias("id"), F.concat_ws(" ", "subject_text", "predicate", "object_text", F.lit("is"), "status").alias("line"))
    ids = F.array(*(F.struct(F.lit(vd).alias("vd"), F.col(c).alias("id")) for vd, c in ((True, "left_claim_id"), (True, "right_claim_id"), (False, "left_triple_id"), (False, "right_triple_id"))))
    entry = F.struct("id", "line")

    def gathered(conflicts: DataFrame, repeated: bool) -> DataFrame:
        """What each conflict names itself; repeated: a hash may be there several times and name an id again."""
        asked = conflicts.select(*keys, F.explode(F.array_distinct(F.filter(ids, lambda x: x["id"].isNotNull()))).alias("x")).select(*keys, "x.*")
        asked = asked.distinct() if repeated else asked
        found = asked.hint("shuffle_hash").join(verdict.unionByName(triple), ["corpus_id", "vd", "id"]).select(*keys, "vd", "id", "line")
        none = lambda c: F.lit(None).cast(found.schema[c].dataType).alias(c)
        subject = F.lower("subject_text").alias("subject_key")
        rows = found.withColumn("subject_key", F.lit(None).cast("string")).unionByName(conflicts.select(*keys, none("vd"), none("id"), none("line"), subject))
        return rows.groupBy(*keys).agg(F.collect_list("subject_key").alias("subjects"), F.count_if(F.col("vd").isNull()).alias("n"), F.collect_list(F.when(F.col("vd"), entry)).alias("vds"), F.collect_list(F.when(~F.col("vd"), entry)).alias("trs"))

    made = lambda kind, category: lambda x: _fact(kind, x["id"], category, x["line"])
    own = saved(gathered(conflicts, False), "conflict-lines")
    first = Window.partitionBy("corpus_id", "subject_key").orderBy("claim_id")
    some = claims.select("corpus_id", F.lower("subject").alias("subject_key"), "claim_id").filter("subject_key is not null").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most).select("corpus_id", "subject_key", F.col("claim_id").alias("id")).distinct()
    lines = verdict.select("corpus_id", "id", _fact("VD", F.col("id"), "VERDICT", F.col("line")).alias("fact"))
    about = some.hint("shuffle_hash").join(lines, ["corpus_id", "id"]).groupBy("corpus_id", "subject_key").agg(F.collect_list(F.struct("id", "fact")).alias("about"))
    no_facts = F.array().cast("array<struct<fact_id:string,category:string,line:string>>")
    known = F.transform("vds", lambda x: x["id"])
    theirs = F.transform(F.filter("about", lambda x: ~F.array_contains("known", x["id"])), lambda x: x["fact"])
    out = own.filter("n = 1").select("*", F.get("subjects", F.lit(0)).alias("subject_key"), known.alias("known")).join(about, ["corpus_id", "subject_key"], "left").select(*keys, "vds", "trs", F.coalesce(theirs, no_facts).alias("theirs"))
    # Subjects that differ in white space only can meet in one conflict.
    more = own.filter("n > 1").select(*keys)
    if not more.isEmpty():
        more = saved(gathered(conflicts.join(more, keys, "left_semi"), True), "conflict-lines")
        of = more.select(*keys, known.alias("known"), F.explode(F.array_distinct("subjects")).alias("subject_key")).join(some, ["corpus_id", "subject_key"]).filter(~F.array_contains("known", F.col("id"))).select(*keys, "id").distinct()
        of = of.join(lines, ["corpus_id", "id"]).groupBy(*keys).agg(F.collect_list("fact").alias("theirs"))
        out = out.unionByName(more.join(of, keys, "left").select(*keys, "vds", "trs", F.coalesce("theirs", no_facts).alias("theirs")))

    gap = lambda missing, name, text: F.when(missing, F.array(_fact("GAP", F.lit(name), "GAP", F.lit(text)))).otherwise(no_facts)
    gaps = [gap((F.size("vds") == 0) & (F.size("theirs") == 0), "VERDICT", "no verdict on the claims in conflict"), gap(F.size("trs") == 0, "TRIPLE", "no triple in conflict")]
    return out.select(*keys, F.concat(F.transform("vds", made("VD", "VERDICT")), "theirs", F.transform("trs", made("TR", "TRIPLE")), *gaps).alias("facts"))


def corpus_facts(conflicts: DataFrame, ranks: DataFrame, communities: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """Facts of a whole corpus, with a null conflict_hash: PR- the best-ranked nodes, COM- the first members of communities, COM-TOTAL their number, GAP- an empty graph."""
    row = lambda df, *what: df.select("corpus_id", F.lit(None).cast("string").alias("conflict_hash"), _fact(*what).alias("f")).select("corpus_id", "conflict_hash", "f.*")
    pr = row(ranks.filter(F.col("rank") <= most), "PR", F.col("node_id"), "PAGERANK", F.concat_ws(" ", "name", F.lit("has rank"), F.col("rank").cast("string")))
    sizes = communities.groupBy("corpus_id", "community").agg(F.count("*").alias("size"))
    order = Window.partitionBy("corpus_id").orderBy("community", "node_id")
    some = communities.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).join(sizes, ["corpus_id", "community"]).join(names, ["corpus_id", "node_id"], "left")
    com = row(some, "COM", F.concat_ws("-", F.col("community").cast("string"), F.col("node_id").cast("string")), "COMMUNITY", F.concat_ws(" ", "name", F.lit("in community"), F.col("community").cast("string"), F.lit("of"), F.col("size").cast("string")))
    total = row(sizes.groupBy("corpus_id").agg(F.count("*").alias("n")), "COM", F.lit("TOTAL"), "COMMUNITY_SUMMARY", F.concat_ws(" ", F.col("n").cast("string"), F.lit("communities")))
    empty = row(conflicts.select("corpus_id").distinct().join(communities.select("corpus_id").distinct(), "corpus_id", "left_anti"), "GAP", F.lit("GRAPH"), "GAP", F.lit("the graph of approved triples is empty"))
    return reduce(DataFrame.unionByName, [pr, com, total, empty])


def machine_facts(conflicts: DataFrame, claims: DataFrame, verdicts: DataFrame, triples: DataFrame, ranks: DataFrame, communities: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """Fact lines for the brief of every contradiction; those of a whole corpus come once, with a null conflict_hash.

    claims: approved ones; ranks: node_id, rank and name; communities: node_id and community; names: node_id and name.
    All have corpus_id.
    """
    own = conflict_facts(conflicts, claims, verdicts, triples, most)
    rows = own.select("corpus_id", "conflict_hash", F.explode("facts").alias("f")).select("corpus_id", "conflict_hash", "f.*")
    return rows.unionByName(corpus_facts(conflicts, ranks, communities, names, most))


#: Kinds of facts in the order of a brief.
BRIEF_ORDER = ["VERDICT", "TRIPLE", "PAGERANK", "COMMUNITY", "COMMUNITY_SUMMARY", "GAP"]


def _section(category: Column, lines: Column) -> Column:
    return F.struct(F.array_position(F.array(*map(F.lit, BRIEF_ORDER)), category).alias("place"), F.concat(F.lit("["), category, F.lit("]\n"), F.array_join(F.array_sort(lines), "\n")).alias("text"))


def brief_texts(own: DataFrame, shared: DataFrame) -> DataFrame:
    """One text per contradiction: own has its facts in an array, as ``conflict_facts`` gives them, shared the rows of whole corpora."""
    parts = F.array_distinct(F.transform("facts", lambda x: x["category"]))
    line = lambda x: F.concat_ws(": ", x["fact_id"], x["line"])
    sections = F.transform(parts, lambda c: _section(c, F.transform(F.filter("facts", lambda x: x["category"] == c), line)))
    common = shared.groupBy("corpus_id", "category").agg(F.collect_list(F.concat_ws(": ", "fact_id", "line")).alias("lines"))
    common = common.groupBy("corpus_id").agg(F.collect_list(_section(F.col("category"), F.col("lines"))).alias("shared"))  # some twenty lines
    both = F.array_sort(F.concat(sections, F.coalesce("shared", F.array().cast("array<struct<place:bigint,text:string>>"))))
    return own.join(F.broadcast(common), "corpus_id", "left").select("corpus_id", "conflict_hash", F.array_join(F.transform(both, lambda x: x["text"]), "\n\n").alias("brief"))


def brief_render(facts: DataFrame) -> DataFrame:
    """One text per contradiction, from rows: its facts and those of its corpus under their category."""
    own = facts.filter("conflict_hash is not null").groupBy("corpus_id", "conflict_hash").agg(F.collect_list(F.struct("fact_id", "category", "line")).alias("facts"))
    return brief_texts(own, facts.filter("conflict_hash is null"))


def report_view(blocks: DataFrame, citations: DataFrame) -> DataFrame:
    """Reports with their blocks in order, each with its citations and how many of those don't name exactly one target.

    blocks: report_id, seq and block_id; citations: block_id, place and a column for each kind of target, named .._ref.
    """
    targets = [c for c in citations.columns if c.endswith("_ref")]
    n = sum((F.col(c).isNotNull().cast("int") for c in targets), F.lit(0))
    c = citations.withColumn("n_targets", n).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("place", *targets))).alias("citations"), F.count_if(F.col("n_targets") != 1).alias("n_bad"))
    rows = blocks.join(c, "block_id", "left").fillna(0, ["n_bad"])
    none = F.array().cast(c.schema["citations"].dataType)
    row = F.struct("seq", "block_id", "n_bad", F.coalesce("citations", none).alias("citations"))
    return rows.groupBy("report_id").agg(F.count("*").alias("n_blocks"), F.sum("n_bad").alias("n_bad"), F.array_sort(F.collect_list(row)).alias("blocks"))


def chat_session_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


def chat_history(messages: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("turn", "role")
    return messages.select("session_id", F.row_number().over(order).alias("place"), "role", F.length("content").cast("long").alias("n_chars"))


def stale_jobs(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Running jobs without a heartbeat since a time, and what becomes of them; attempts are kept."""
    late = jobs.filter("status = 'RUNNING'").filter(F.col("heartbeat").isNull() | (F.col("heartbeat") < cutoff))
    then = F.when(F.col("document_id").isNull(), "FAILED").when(F.col("attempt_count") >= F.col("max_attempts"), "ABANDONED").otherwise("PENDING")
    return late.withColumn("next_status", then)


def stale_runs(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Stale runs fail and their documents wait for approval again, once each."""
    late = runs.filter("status = 'RUNNING'").filter(F.col("heartbeat").isNull() | (F.col("heartbeat") < cutoff))
    return late.groupBy("document_id").agg(F.count("*").alias("n_runs")).withColumn("document_status", F.lit("AWAITING_APPROVAL"))


def rate_nth_call(calls: DataFrame, gap_seconds: int, limit: int) -> DataFrame:
    """Calls numbered within sessions that end after a gap: is the n-th allowed, and how many remain."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) > gap_seconds * 1_000_000, F.lit(True))
    rows = calls.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("session", F.sum(new.cast("int")).over(order))
    nth = F.row_number().over(Window.partitionBy("user_id", "session").orderBy("ts", "event_id"))
    return rows.withColumn("nth", nth).select("user_id", "event_id", "session", "nth", (F.col("nth") <= limit).alias("allowed"), F.greatest(F.lit(0), F.lit(limit) - F.col("nth")).alias("remaining"))


def page_envelope(df: DataFrame, by: list[str], order: list[Column], page: int, size: int) -> DataFrame:
    """One page of every group, with totals: page from 0, size 1 at least."""
    page, size = max(0, page), max(1, size)
    rows = numbered(df, by, order, "nth", "total_elements").withColumn("total_pages", F.ceil(F.col("total_elements") / size))
    return rows.filter((F.col("nth") > page * size) & (F.col("nth") <= (page + 1) * size)).withColumn("has_next", F.lit(page + 1) < F.col("total_pages"))


def newest_first(df: DataFrame, order: str, status: str | None = None, most: int = 50) -> DataFrame:
    """The newest rows of each corpus, of one status if given."""
    rows = df if status is None else df.filter(F.col("status") == status)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("corpus_id").orderBy(F.desc(order)))).filter(F.col("nth") <= most)
