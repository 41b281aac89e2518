"""Work that grows with the input: the same results, without pairs of a group or expressions made again and again."""

import json
import time

import duckdb
from pyspark.sql import functions as F

from attest import catalog, fixtures
from attest.functions import scores as S
from attest.functions import text as T
from attest.operators import claims as C
from attest.operators import contradictions as X
from attest.operators import evaluation as E
from attest.operators import graph as G
from attest.operators import replies as P
from attest.operators import retrieval as R
from attest.operators import views as W


def test_gold_of_one_large_document(spark):
    """20,000 sentences against 4,000 chunks of one document: looked up, not compared with each other."""
    gold = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("gold_id"), F.concat(F.lit("Part_"), F.col("id").cast("string"), F.lit(" comes from here.")).alias("sentence"))
    chunks = gold.groupBy("doc_id", F.floor(F.col("gold_id") / 5).alias("chunk_index")).agg(F.array_join(F.collect_list("sentence"), " ").alias("content"))
    began = time.time()
    placed, lost = E.place_gold(gold, chunks)
    assert placed.filter("chunk_index = floor(gold_id / 5)").count() == 20_000 and lost.count() == 0
    assert time.time() - began < 60


def test_gold_is_a_run_of_words(spark):
    chunks = spark.createDataFrame([("d", 2, "the Mill, owns it"), ("d", 1, "a mill  owns itself"), ("d", 3, "mill owns it"), ("e", 0, ""), ("f", 0, None)], "doc_id string, chunk_index long, content string")
    gold = spark.createDataFrame([("d", "MILL owns it."), ("d", "mill owns"), ("d", "owns it now or never"), ("d", "?"), ("d", None), ("e", "!"), ("f", "mill")], "doc_id string, sentence string")
    placed, lost = E.place_gold(gold, chunks)
    assert {(r["doc_id"], r["sentence"], r["chunk_index"]) for r in placed.collect()} == {("d", "MILL owns it.", 2), ("d", "mill owns", 1), ("e", "!", 0)}
    assert {(r["doc_id"], r["sentence"]) for r in lost.collect()} == {("d", "owns it now or never"), ("d", "?"), ("d", None), ("f", "mill")}


def test_replies_are_parsed_once(spark):
    """The plan of a filter on what a check found has the search for the object in one place."""
    raw = spark.createDataFrame([(1, "{}", [1])], "reply_id long, raw_text string, allowed array<long>")
    names = raw.withColumn("allowed", F.array(F.lit("A1")))
    found = [P.quarantine_split(P.reply_schema_check(raw))[1], P.judge_reply_check(raw).filter("reason is null"), P.chat_reply_check(raw).filter("reason is null"), P.persona_reply_check(names).filter("reason is null"), P.synthesis_reply_check(names, ["X"]).filter("reason is null")]
    for df in found:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_ranks_of_two_layers_need_no_rounds(spark, monkeypatch):
    """Suppliers and customers: the same ranks as by rounds, which run only where a node that is linked to links on."""
    rows = [(1, a, "p", 100 + b) for a in range(4) for b in range(5) if (a * b) % 3] + [(2, 7, "p", 9), (2, 8, "p", 9), (2, 6, "p", 6)]
    edges = spark.createDataFrame(rows, "corpus_id long, subject_id long, predicate string, object_id long")
    rounds, called = G._ranks_by_rounds, []
    monkeypatch.setattr(G, "_ranks_by_rounds", lambda *a: called.append(1) or rounds(*a))
    got = sorted(map(tuple, G.pagerank(edges, iterations=5).collect()))
    assert not called
    monkeypatch.setattr(G, "_ranks_of_layers", rounds)
    assert sorted(map(tuple, G.pagerank(edges, iterations=5).collect())) == got
    G.pagerank(spark.createDataFrame([(1, 1, "p", 2), (1, 2, "p", 3)], edges.schema), iterations=1).collect()
    assert called


def test_queries_of_equal_terms_are_ranked_once(spark):
    """Terms that every chunk has weigh nothing and aren't scored; queries that ask for the same terms share one ranking."""
    chunks = spark.createDataFrame([(1, k, f"common words here {'alpha' if k % 2 else 'beta'}") for k in range(6)], "corpus_id long, chunk_id long, content string")
    queries = spark.createDataFrame([(1, q, f"common name{q} {'alpha' if q % 3 else 'common'}") for q in range(30)], "corpus_id long, query_id long, query_text string")
    of, shared = R.shared_queries(R.query_terms(queries), R.index_terms(chunks).filter("term = 'alpha'"))
    assert shared.count() == 1 and of.count() == 20
    got = {(r["query_id"], r["chunk_id"], r["rank"]) for r in R.retrieve_topk(queries, chunks).collect()}
    assert got == {(q, c, n) for q in range(30) if q % 3 for n, c in enumerate((1, 3, 5), 1)}


def test_wording_is_mapped_not_matched(spark):
    """Plain claims and labels take no pattern over every character, and are as before for odd characters."""
    texts = ["\U0001f600a\t\tb\x0bc\fd--e  x y\x00z\x85q", "", None, "  ", "Éİİß KK ſ", "a\U0001f600\U0001f601b", "$^\\[]-a", "No ONE - said_so"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    match = lambda kept: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), rf"[^a-z0-9\s{kept}]", " "), r"\s+", " "))
    got = df.select(S.claim_plain(F.col("t")).alias("a"), match("-").alias("b"), T.norm_label(F.col("t")).alias("c"), match("").alias("d"))
    assert got.filter("a <> b or c <> d").count() == 0 and got.count() == len(texts)
    assert "[^a-z0-9" not in got.select("a", "c")._jdf.queryExecution().optimizedPlan().toString()


def test_facts_read_lines_and_orders_once():
    text = fixtures.sql("facts", "spark")
    assert text.count("lineitem join") == 1 and text.count("from orders") == 1


def test_facts_stay_with_their_contradiction(spark):
    """Arrays of a contradiction's facts give the briefs that its rows give; equal hashes of two spellings of a subject are one."""
    conflicts = spark.createDataFrame([(1, "x", 10, 11, 5, None, "Mill"), (1, "x", 10, 12, 5, 6, " mill"), (1, "y", None, None, None, 9, "Dam")], "corpus_id long, conflict_hash string, left_claim_id long, right_claim_id long, left_triple_id long, right_triple_id long, subject_text string")
    claims = spark.createDataFrame([(1, k, s) for k, s in ((10, "MILL"), (13, "mill"), (14, " mill"), (15, "Weir"))], "corpus_id long, claim_id long, subject string")
    verdicts = spark.createDataFrame([(1, k, "Mill", "owns", "Dam", "SUPPORTED") for k in (10, 10, 12, 13, 14, 15)], "corpus_id long, claim_id long, subject string, predicate string, object_text string, verdict string")
    triples = spark.createDataFrame([(1, 5, "Mill", "owns", "Dam", "APPROVED")], "corpus_id long, triple_id long, subject_text string, predicate string, object_text string, status string")
    own = W.conflict_facts(conflicts, claims, verdicts, triples)
    got = {r["conflict_hash"]: sorted(f["fact_id"] for f in r["facts"]) for r in own.collect()}
    assert got == {"x": ["TR-5", "VD-10", "VD-10", "VD-12", "VD-13", "VD-14"], "y": ["GAP-TRIPLE", "GAP-VERDICT"]}
    none = spark.createDataFrame([], "corpus_id long, conflict_hash string, fact_id string, category string, line string")
    rows = own.select("corpus_id", "conflict_hash", F.inline("facts"))
    assert sorted(map(tuple, W.brief_texts(own, none).collect())) == sorted(map(tuple, W.brief_render(rows).collect()))


def test_prose_counts_take_one_group_a_label(spark):
    """Polarities of a label are compared inside its group; only kinds are joined with each other."""
    item = "doc_id string, chunk_index long, kind string, subject string, predicate string, object string, polarity string, sentence string"
    gold = spark.createDataFrame([("d", None, "CLAIM", "Mill", None, "a dam", x, None) for x in ("POSITIVE", "NEGATIVE", "NEGATIVE")], item).drop("chunk_index", "sentence")
    predicted = spark.createDataFrame([("d", 1, "CLAIM", "mill", None, "A dam!", x, "mill") for x in ("POSITIVE", "NEUTRAL", None)] + [("d", 1, "CLAIM", "weir", None, None, None, "mill")], item)
    got = E.prose_prf(gold, predicted, spark.createDataFrame([("d", 1, "the mill")], "doc_id string, chunk_index long, content string"))
    assert [(r["tp"], r["fp"], r["fn"], r["n_same"]) for r in got.collect()] == [(1, 3, 1, 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FullOuter") == 2


def test_components_drop_links_that_are_joined(spark, monkeypatch):
    """After the first round only links between joined nodes are left; chains and stars of any order come out whole."""
    cut, left = G._cut, []
    monkeypatch.setattr(G, "_cut", lambda df: (lambda out: (left.append(out.count()) if out.columns == ["corpus_id", "a", "b"] else None) or out)(cut(df)))
    rows = [(1, a, "p", 100 + b) for a in range(6) for b in range(6)] + [(2, (k * 7) % 50, "p", ((k + 1) * 7) % 50) for k in range(48)] + [(3, k, "p", 99) for k in range(20)] + [(4, 5, "p", 5), (4, 9, "q", 7), (4, 7, "p", 9)]
    edges = spark.createDataFrame(rows, "corpus_id long, subject_id long, predicate string, object_id long")
    got = {(r["corpus_id"], r["node_id"]): r["component"] for r in G.connected_components(edges).collect()}
    assert {k: c for (n, k), c in got.items() if n == 4} == {5: 5, 7: 7, 9: 7}
    assert all(c == 0 for (n, k), c in got.items() if n in (1, 3)) and len({c for (n, k), c in got.items() if n == 2}) == 1 and len(got) == 12 + 49 + 21 + 3
    assert left[0] < len(rows) / 2 and left[-1] == 0


def test_rounds_end_where_labels_settle(spark, monkeypatch):
    cut, written = G._cut, []
    monkeypatch.setattr(G, "_cut", lambda df: written.append(1) or cut(df))
    triangle = spark.createDataFrame([(1, 1, "p", 2), (1, 2, "p", 3), (1, 3, "p", 1)], "corpus_id long, subject_id long, predicate string, object_id long")
    assert {tuple(r) for r in G.sync_labels(triangle, 8).collect()} == {(1, 1, 1), (1, 2, 1), (1, 3, 1)}
    assert len(written) < 8


def test_refused_questions_need_no_ranks(spark, monkeypatch):
    """Whether a question has a passage is known from its terms; no chunk is ranked, and the result is that of the SQL."""
    def ranked(*a, **k):
        raise AssertionError("ranked")

    monkeypatch.setattr(R, "best_of_blocks", ranked)
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["chat_refused"](spark, sf).select("corpus_id", "question_id").collect()))
    assert got == sorted(con.execute(catalog.ORACLES["chat_refused"]).fetchall()) and got


def test_any_passage_is_what_ranking_finds(spark):
    """Terms of nearly all chunks weigh less than a score shows; two of them in a chunk may weigh enough."""
    often = "often " * 10 + "twice " * 10
    chunks = spark.range(2000).select(F.lit(1).cast("long").alias("corpus_id"), F.col("id").alias("chunk_id"), F.when(F.col("id") == 0, "twice").when(F.col("id") == 1, "often rare").otherwise(often).alias("content"))
    texts = ["often", "twice", "often twice", "rare", "often rare", "unknown", "", None, "unknown often"]
    queries = spark.createDataFrame([(n, q, t) for n in (1, 2) for q, t in enumerate(texts)], "corpus_id long, query_id long, query_text string")
    got = sorted(map(tuple, R.retrieve_any(queries, chunks).collect()))
    assert got == sorted({(r["corpus_id"], r["query_id"]) for r in R.retrieve_topk(queries, chunks).collect()}) == [(1, 2), (1, 3), (1, 4)]


def test_questions_that_begin_like_names_are_not_paired(spark):
    """40,000 questions and 40,000 names of one beginning, in one corpus: looked up, not compared with each other."""
    names = spark.range(40_000).select(F.lit(1).cast("long").alias("corpus_id"), F.col("id").alias("triple_id"), F.concat(F.lit("The Customer#"), F.format_string("%07d", "id")).alias("subject_text"), F.lit("O").alias("object_text"), F.lit("APPROVED").alias("status"))
    asked = names.select("corpus_id", F.col("triple_id").alias("question_id"), F.concat(F.lit(" customer#"), F.format_string("%07d", F.col("triple_id") * 2)).alias("question"))
    began = time.time()
    assert sorted(map(tuple, R.chat_triples(asked, names).select("question_id", "triple_id").collect())) == [(q, 2 * q) for q in range(20_000)]
    assert time.time() - began < 60


def test_names_that_hold_a_question(spark):
    """Any place of a name, any case, any length of the question; names of facts that aren't approved don't count."""
    t = [(1, 1, "Ann an Dam", "o", "APPROVED"), (1, 2, "An Dam", "Ann", "PENDING"), (2, 3, "Weir", None, "APPROVED"), (1, 4, "", "DAM Dam", "APPROVED"), (1, 5, "\u0130ly Dam", "x", "APPROVED")]
    triples = spark.createDataFrame(t, "corpus_id long, triple_id long, subject_text string, object_text string, status string")
    q = [(n, k, x) for n in (1, 2, 3) for k, x in enumerate(["an dam", "an", "DAM", " n ", "weir", "ann an dam of", "", None, "dam d", "eir", "o"])]
    asked = spark.createDataFrame(q, "corpus_id long, question_id long, question string")
    low = [(n, x.lower()) for n, _, s, o, status in t if status == "APPROVED" for x in (s, o) if x]
    want = {(n, k) for n, k, x in q if x and x.strip() and any(m == n and x.strip().lower() in y for m, y in low)}
    assert {(r["corpus_id"], r["question_id"]) for r in R.chat_names(asked, triples).collect()} == want
    assert {(r["question_id"], r["triple_id"]) for r in R.chat_triples(asked, triples).filter("corpus_id = 1").collect()} >= {(2, 1), (2, 4), (2, 5), (8, 4)}


def test_facts_that_repeat_in_another_spelling_are_one(spark):
    fact = {"subject": "Tarn Quarry", "predicate": "owns", "object": "Slate Wharf", "sentence": "tarn quarry owns Slate Wharf"}
    replies = [(k, json.dumps({"triples": [fact, {**fact, "object": o}], "claims": []}), "Tarn Quarry owns Slate Wharf.") for k, o in enumerate((" slate  WHARF", "Brightwater Mill"))]
    df = spark.createDataFrame(replies, "reply_id long, raw_text string, content string")
    assert {r["reply_id"]: len(r["triples"]) for r in P.reply_items_check(P.reply_schema_check(df)).collect()} == {0: 1, 1: 2}


def _in_order(links, sweeps=8):
    """Labels node by node, in plain Python."""
    near = {}
    for a, b in links:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {k: k for k in near}
    for _ in range(sweeps):
        for k in sorted(k for k in near if near[k]):
            votes = [label[x] for x in near[k]]
            label[k] = min(set(votes), key=lambda v: (-votes.count(v), v))
    return label


def test_labels_of_two_layers_need_no_levels(spark, monkeypatch):
    """Suppliers and customers: the labels of node by node, without finding levels; those are found where a node is between two others."""
    rows = {(n, (a * 37) % 90, 100 + (a * a + 11 * n) % 70) for n in (1, 2) for a in range(260)} | {(3, 5, 5), (3, 6, 4), (3, 8, 4), (3, 9, 4)}
    edges = spark.createDataFrame([(n, a, p, b) for n, a, b in sorted(rows) for p in ("p", "q")], "corpus_id long, subject_id long, predicate string, object_id long")
    levels, called = G.wave_levels, []
    monkeypatch.setattr(G, "wave_levels", lambda *a: called.append(1) or levels(*a))
    for sweeps in (1, 2, 8):
        got = {(r["corpus_id"], r["node_id"]): r["label"] for r in G.wave_labels(edges, sweeps).collect()}
        assert got == {(n, k): v for n in (1, 2, 3) for k, v in _in_order([(a, b) for m, a, b in rows if m == n], sweeps).items()}
    assert not called
    path = [(1, 2), (2, 3), (3, 2), (7, 9), (9, 7)]
    got = {r["node_id"]: r["label"] for r in G.wave_labels(spark.createDataFrame([(1, a, "p", b) for a, b in path], edges.schema)).collect()}
    assert got == _in_order(path) and called


def test_ends_are_counted_in_one_sum(spark):
    edges = spark.createDataFrame([(1, 1, "p", 2), (1, 1, "q", 2), (1, 2, "p", 1), (1, 3, "p", 3), (1, 1, "p", 4)], "corpus_id long, subject_id long, predicate string, object_id long")
    got = G.graph_ends(G.graph_links(edges))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1, 2, 4), (1, 2, 1, 1, 1, 1), (1, 3, 0, 0, None, None), (1, 4, 0, 1, 1, 1)]
    want = G.graph_degree(edges).select("node_id", "out_degree", "in_degree")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_lines_are_joined_with_keys_only_once_for_edges():
    """Orders meet their customers before the lines do, so lines are dealt by order and not again by customer."""
    text = fixtures.sql("edges", "spark")
    assert text.index("orders join customer") > text.index("from lineitem") and "lineitem join orders" not in text


def test_runs_that_no_sentence_begins_or_ends_are_not_made(spark, monkeypatch):
    """Of the runs of a chunk those are made that begin and end as a sentence of its document does; the result is that of all."""
    gold = spark.createDataFrame([("d", f"mill{k % 3} owns part{k}") for k in range(40)] + [("d", "mill1 owns"), ("e", "x y z")], "doc_id string, sentence string")
    words = " ".join(f"mill{k % 3} owns part{k}. and so on, as word{k} was said" for k in range(39))
    chunks = spark.createDataFrame([("d", c, words) for c in (4, 2)] + [("e", 0, "z y x")], "doc_id string, chunk_index long, content string")
    saved, plans = E.saved, []
    monkeypatch.setattr(E, "saved", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, name))
    placed, lost = E.place_gold(gold, chunks)
    assert {(r["sentence"], r["chunk_index"]) for r in placed.collect()} == {(f"mill{k % 3} owns part{k}", 2) for k in range(39)} | {("mill1 owns", 2)}
    assert {r["sentence"] for r in lost.collect()} == {"mill0 owns part39", "x y z"}
    assert "bit_or" in plans[0] and plans[0].count("Join") == 2


def test_labels_of_chunks_are_compared_in_one_group(spark):
    """Nothing that was predicted in a chunk that went wrong counts, and all its gold is missed; chunks without either count."""
    gold = spark.createDataFrame([("d", "a", "p", "b", "a p b"), ("d", "A", "p", "B!", "a p b"), ("d", "c", "p", "d", "c p d"), ("d", "x", "p", "y", None)], "doc_id string, subject string, predicate string, object string, sentence string")
    chunks = spark.createDataFrame([("d", 0, "a p b", "OK", 1), ("d", 1, "c p d", "FAILED", 1), ("d", 2, None, "MALFORMED", 1), ("e", 0, "z", "OK", 2)], "doc_id string, chunk_index long, content string, outcome string, part int")
    said = spark.createDataFrame([("d", 0, "a", "p", "b"), ("d", 0, "a", "p", "z"), ("d", 1, "c", "p", "d"), ("d", 1, "c", "p", "e"), ("d", 7, "c", "p", "d")], "doc_id string, chunk_index long, subject string, predicate string, object string")
    out = E.extraction_report(gold, said, chunks, ["part"])
    got = {r["part"]: (r["tp"], r["fp"], r["fn"], r["n_chunks"], r["n_failed"], r["n_unplaced"]) for r in out.collect()}
    assert got == {1: (1, 1, 1, 3, 1, 1), 2: (0, 0, 0, 1, 0, 0)}
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()


def _in_rounds(links, sweeps):
    """Labels after so many rounds of all nodes at once, in plain Python."""
    near = {}
    for a, b in links:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {k: k for k in near}
    for _ in range(sweeps):
        votes = {k: [label[x] for x in v] for k, v in near.items()}
        label = {k: min(set(v), key=lambda x: (-v.count(x), x)) if v else label[k] for k, v in votes.items()}
    return label


def test_rounds_read_links_from_either_end(spark, monkeypatch):
    """The first round reads no links, and links of two layers aren't written both ways; labels are those of plain rounds."""
    cut, written = G._cut, []
    monkeypatch.setattr(G, "_cut", lambda df: written.append(df.columns) or cut(df))
    two = {((a * 37) % 30, 100 + (a * a) % 23) for a in range(90)} | {(5, 5), (40, 40)}
    for links in (two, {(1, 2), (2, 1), (2, 3), (3, 4), (4, 4), (9, 8)}):
        edges = spark.createDataFrame([(1, a, p, b) for a, b in sorted(links) for p in ("p", "q")], "corpus_id long, subject_id long, predicate string, object_id long")
        for sweeps in (0, 1, 3):
            del written[:]
            assert {r["node_id"]: r["label"] for r in G.sync_labels(edges, sweeps).collect()} == _in_rounds(links, sweeps)
            assert (["corpus_id", "node_id", "other"] in written) == (links is not two and sweeps > 1)


def test_texts_are_read_where_the_verdict_hangs_on_them(spark):
    """Verdicts are those of all rules; no wording is looked at where the judge's reply settles the verdict."""
    rows = [(k, 1, t, v, e, x) for k, (t, v, e, x) in enumerate((t, v, e, x) for t in ("always reportedly may never", "plain", None) for v in ("SUPPORTED", "CONTRADICTED", None) for e in ("EVIDENCE_FOUND", "NO_EVIDENCE", None) for x in (0.3, 0.6, None))]
    all_of = spark.createDataFrame(rows, "claim_id long, corpus_id long, claim_text string, judge_verdict string, evidence string, score double")
    judge = all_of.select("claim_id", "judge_verdict", "evidence", "score")
    claims = all_of.select("claim_id", "corpus_id", "claim_text")
    want = {r["claim_id"]: r["verdict"] for r in C.settle(C.claim_rules(claims).join(judge, "claim_id")).collect()}
    assert {r["claim_id"]: r["verdict"] for r in C.verdicts(claims, judge).collect()} == want and "EXAGGERATED" in want.values()


def test_polarities_meet_without_sorting_spellings(spark):
    """The first claim of either side by id, spelled as it is; an id that is there twice gives one conflict."""
    rows = [(1, 7, "Mill", "OWNS", "Dam ", "POSITIVE"), (1, 5, "Mill", "owns", "dam", "NEGATIVE"), (1, 7, "Mill", "Owns", "dam", "POSITIVE"), (1, 9, "Mill", "owns", "dam", "POSITIVE"), (1, 3, "Weir", "owns", "dam", "POSITIVE"), (2, 5, "Mill", "owns", "dam", "NEGATIVE")]
    claims = spark.createDataFrame(rows, "corpus_id long, claim_id long, subject string, predicate string, object_text string, polarity string")
    got = [(r["subject_text"], r["predicate"], r["left_claim_id"], r["right_claim_id"]) for r in X.conflict_polarity(claims).collect()]
    assert got == [("Mill", "OWNS", 7, 5)]


def test_ids_of_a_conflict_are_not_taken_again_from_its_subject(spark):
    """A conflict of one row, one that names an id twice, and one of two rows and two spellings: each id's lines come once."""
    conflicts = spark.createDataFrame([(1, "a", 10, 10, None, None, "Mill"), (1, "b", 10, None, 5, 5, "Mill"), (1, "b", 10, 11, 5, None, " mill"), (1, "c", None, None, 5, None, None)], "corpus_id long, conflict_hash string, left_claim_id long, right_claim_id long, left_triple_id long, right_triple_id long, subject_text string")
    claims = spark.createDataFrame([(1, 10, "Mill"), (1, 10, "mill"), (1, 12, " MILL"), (1, 12, "mill"), (1, 13, None)], "corpus_id long, claim_id long, subject string")
    verdicts = spark.createDataFrame([(1, k, "Mill", "owns", o, "SUPPORTED") for k, o in ((10, "Dam"), (10, "Weir"), (11, "Dam"), (12, "Dam"), (12, "Dam"))], "corpus_id long, claim_id long, subject string, predicate string, object_text string, verdict string")
    triples = spark.createDataFrame([(1, 5, "Mill", "owns", "Dam", "APPROVED")], "corpus_id long, triple_id long, subject_text string, predicate string, object_text string, status string")
    got = {r["conflict_hash"]: sorted(f["fact_id"] for f in r["facts"]) for r in W.conflict_facts(conflicts, claims, verdicts, triples).collect()}
    assert got == {"a": ["GAP-TRIPLE"] + ["VD-10"] * 2 + ["VD-12"] * 2, "b": ["TR-5"] + ["VD-10"] * 2 + ["VD-11"] + ["VD-12"] * 2, "c": ["GAP-VERDICT", "TR-5"]}


def test_community_rows_have_all_members(spark):
    """Members and names in order, in pieces; a node without a name keeps its place. At the smallest size the rows are those of the SQL."""
    members = spark.createDataFrame([(1, k, k % 2) for k in range(9)] + [(2, 5, 0)], "corpus_id long, node_id long, community long")
    names = spark.createDataFrame([(1, k, f"n{k}") for k in range(8)], "corpus_id long, node_id long, name string")
    got = {(r["corpus_id"], r["community"], r["piece"]): (r["size"], r["first_member"], r["last_member"], r["members"], r["names"]) for r in G.community_rows(members, names, 3).collect()}
    assert got == {(1, 0, 0): (5, 0, 8, [0, 2, 4], ["n0", "n2", "n4"]), (1, 0, 1): (5, 0, 8, [6, 8], ["n6", None]), (1, 1, 0): (4, 1, 7, [1, 3, 5], ["n1", "n3", "n5"]), (1, 1, 1): (4, 1, 7, [7], ["n7"]), (2, 0, 0): (1, 5, 5, [5], [None])}
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(catalog.ORACLES["community_rows"])
    columns = [c[0] for c in found.description]
    out = catalog.QUERIES["community_rows"](spark, sf)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(found.fetchall())
