"""Hand-computed cases for single operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attest import vocabulary as V
from attest.functions import scores as S
from attest.functions import text as T
from attest.operators import claims as C
from attest.operators import contradictions as X
from attest.operators import documents as D
from attest.operators import evaluation as E
from attest.operators import graph as G
from attest.operators import replies as P
from attest.operators import retrieval as R
from attest.operators import views as W


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def _wording(seed):
    """Words with terms of each kind strewn among them, and how many count."""
    r = random.Random(seed)
    words, weasels, absolutes = [], 0, 0
    for _ in range(r.randrange(14)):
        words.append(r.choice(["pebble", "orchard", "47", "kiln", "tide-table", "ørsted"]))
        kind = r.randrange(4)
        if kind == 0:
            words.append(r.choice(V.WEASEL_TERMS))
            weasels += 1
        elif kind == 1:
            words.append(r.choice(V.ABSOLUTE_TERMS))
            absolutes += 1
        elif kind == 2:
            words += [r.choice(V.NEGATORS), r.choice(V.ABSOLUTE_TERMS)]
            absolutes += words[-2] in V.ABSOLUTE_TERMS  # a negator may be a term itself
    return " ".join(r.choice([w, w.upper(), w + r.choice(",;:")]) for w in words), weasels, absolutes


def test_claim_rules(spark):
    cases = [(k, *_wording(k)) for k in range(120)] + [(200, "", 0, 0), (201, None, 0, 0), (202, " \t?!", 0, 0)]
    df = spark.createDataFrame([(k, t) for k, t, _, _ in cases], "claim_id long, claim_text string")
    got = {r["claim_id"]: (r["weasels"], r["absolutes"], r["penalty"]) for r in C.claim_rules(df).collect()}
    for k, text, w, a in cases:
        assert got[k] == (w, a, int(min(w * 0.04 + a * 0.06, 0.4) * 1000 + 0.5) / 1000), text
    assert max(p for _, _, p in got.values()) == 0.4 and min(p for _, _, p in got.values()) == 0


def test_claim_explanation(spark):
    df = spark.createDataFrame([(1, "It may always hold, and may not."), (2, "Plain.")], "claim_id long, claim_text string")
    got = {r["claim_id"]: r["explanation"] for r in C.claim_rule_explain(df).collect()}
    assert got[1].startswith("Hedging terms detected: may. A hedged") and "Absolute terms detected: always." in got[1] and got[1].endswith("Rule penalty 0.140.")
    assert got[2] == "No hedging or overstatement markers detected. Rule penalty 0.000."


def test_fuse_and_resolve(spark):
    rows = [(0.9, 0.12, 0.792), (None, 0.1, None), (1.7, 0.4, 0.6), (float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "s double, p double, want double")
    assert all(r["got"] == r["want"] for r in df.select(S.fuse_score(F.col("s"), F.col("p")).alias("got"), "want").collect())
    rows = [("SUPPORTED", "EVIDENCE_FOUND", 0.12, 0.55, "EXAGGERATED"), ("SUPPORTED", "NO_EVIDENCE", 0.0, 0.9, "SOURCE_MISSING"), (None, "EVIDENCE_FOUND", 0.0, None, "INSUFFICIENT_EVIDENCE"), ("SUPPORTED", "EVIDENCE_FOUND", 0.12, 0.7, "SUPPORTED")]
    df = spark.createDataFrame(rows, "j string, e string, p double, s double, want string")
    assert all(r["got"] == r["want"] for r in df.select(S.resolve_verdict(F.col("j"), F.col("e"), F.col("p"), F.col("s")).alias("got"), "want").collect())


def test_entity_key(spark):
    cases = [(f"Kestrel Dyers {d}", "kestrel dyers") for d in V.DESIGNATORS] + [(d.upper(), d.strip(",;:\"'()[]—–")) for d in V.DESIGNATORS]
    last, other = V.DESIGNATORS[0], V.DESIGNATORS[3]
    cases += [(f"Oriole {other} {last}", f"oriole {other}"), ("\u00a0Wren \u2003 &\tSons", "wren & sons"), ("[(—Dunlin—)]", "dunlin"), ("co-op", "co-op"), ("", ""), (None, ""), (" ; ", "")]
    df = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(cases)], "k int, x string")
    got = {r["k"]: r["y"] for r in df.select("k", T.entity_key(F.col("x")).alias("y")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_query_tokens_and_expansion(spark):
    q = "Who does Tarn collaborate with?"
    assert one(spark, q, T.query_tokens) == ["tarn", "collaborate"]
    assert one(spark, q, lambda c: T.expanded_query(T.query_tokens(c))) == "+tarn +collaborate +collaborates_with"
    assert one(spark, q, lambda c: T.expansions(T.query_tokens(c))) == [("collaborate", "collaborates_with")]
    assert one(spark, "", T.query_tokens) == []


def test_small_text_functions(spark):
    assert one(spark, "50%_a\\b", T.like_escape) == "50\\%\\_a\\\\b"
    assert one(spark, " a\r\nb\x00\tc \n", T.normalize) == "a\nb\tc"
    assert one(spark, "abcdef", lambda c: T.truncate_ellipsis(c, 3)) == "abc…"
    assert one(spark, "/x/my_first-memo.md", T.title_of) == "my first memo" and one(spark, "", T.title_of) == "Untitled document"
    assert one(spark, 'a<b>:"c|?*.txt', T.safe_filename) == "a_b___c___.txt"
    assert one(spark, "x", lambda c: T.phrase_contains(F.lit("The big, red house."), F.lit("big red house"))) is True
    assert one(spark, "x", lambda c: T.phrase_contains(F.lit("The big, red house."), F.lit("red house"))) is False


def _triples(spark, rows):
    return spark.createDataFrame([(1, k, s, p, o, t) for k, (s, p, o, t) in enumerate(rows)], "corpus_id long, triple_id long, subject_text string, predicate string, object_text string, effective_time string")


def _plain_conflicts(rows):
    """Pairs of neighbours in each group of a predicate that holds one value, or too many for its bound."""
    rules = {p[0]: p for p in V.PREDICATES}
    norm = lambda x: (x or "").strip().lower()
    groups = {}
    for k, (s, p, o, t) in enumerate(rows):
        if s is not None and p is not None and p.lower() in rules:
            groups.setdefault((norm(s), p.lower()), []).append((o, k, t))
    found = set()
    for (_, p), own in groups.items():
        _, cardinality, bound, _, _, exclusive, temporal = rules[p]
        if not (cardinality == "SINGLE" and exclusive or cardinality == "BOUNDED" and len(own) > bound):
            continue
        own.sort()
        for (a, i, x), (b, j, y) in zip(own, own[1:]):
            timed = temporal and (x or "").strip() and (y or "").strip() and x.strip().lower() != y.strip().lower()
            if norm(a) != norm(b) and not timed:
                found.add((i, j))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_relation_conflicts(spark, seed):
    r = random.Random(seed)
    names = [p[0] for p in V.PREDICATES] + ["hums", None]
    rows = [(r.choice(["pell", "moth", "Moth ", None]), r.choice(names), r.choice(["reef", "Reef", "quay", "spit", "bar"]), r.choice([None, "", "dawn", "Dawn", "dusk"])) for _ in range(250)]
    got = X.relation_conflicts(_triples(spark, rows)).select("left_triple_id", "right_triple_id").collect()
    assert {(min(x), max(x)) for x in got} == {(min(x), max(x)) for x in _plain_conflicts(rows)} and len(got) > 5


def test_conflicts_do_not_depend_on_order(spark):
    rows = [(f"s{k % 5}", "reports_to", f"o{k % 7}", None) for k in range(60)]
    t = _triples(spark, rows)
    a = sorted(map(tuple, X.relation_conflicts(t).select("conflict_hash").collect()))
    assert a == sorted(map(tuple, X.relation_conflicts(t.orderBy(F.rand(3)).repartition(7)).select("conflict_hash").collect()))
    assert X.new_only(X.relation_conflicts(t), X.relation_conflicts(t)).count() == 0


def test_lifecycle_and_debate(spark):
    ev = [(1, 1, 1, "DEBATE"), (1, 2, 2, "RESOLVE"), (1, 3, 3, "DEBATE"), (1, 4, 4, "DISMISS"), (2, 1, 5, "RESOLVE")]
    got = {r[0]: tuple(r[1:]) for r in X.contradiction_lifecycle(spark.createDataFrame(ev, "contradiction_id long, at long, event_id long, event string")).collect()}
    assert got == {1: ("DISMISSED", 1), 2: ("OPEN", 1)}
    ev = [(1, k, k, e) for k, e in enumerate(["START", *["ARGUED", "WEIGHTS"] * 3, "DONE", "ABORT"])] + [(2, 0, 0, "START")]
    got = {r[0]: tuple(r[1:]) for r in W.debate_fsm(spark.createDataFrame(ev, "debate_id long, at long, event_id long, event string")).collect()}
    assert got == {1: ("COMPLETED", 3, 1), 2: ("ROUND_ACTIVE", 1, 0)}


def _graph(spark, rows):
    return spark.createDataFrame([(1, a, p, b) for a, p, b in rows], "corpus_id long, subject_id long, predicate string, object_id long")


def test_graph_counts_neighbours_once(spark):
    g = _graph(spark, [(1, "controls", 2), (1, "funds", 2), (1, "controls", 1)])
    assert G.graph_edges(g).count() == 2
    assert {r["node_id"]: r["out_degree"] for r in G.graph_degree(g).collect()} == {1: 1, 2: 0}


def test_pagerank(spark):
    two = {r["node_id"]: r["score"] for r in G.pagerank(_graph(spark, [(1, "x", 2), (2, "x", 1)])).collect()}
    assert two == {1: 0.5, 2: 0.5}
    chain = G.pagerank(_graph(spark, [(1, "x", 2), (2, "x", 3), (99, "x", 99)])).collect()
    assert sum(r["score"] for r in chain) == pytest.approx(1, abs=1e-6)
    assert [r["node_id"] for r in sorted(chain, key=lambda r: r["rank"])][:2] == [3, 2]


def test_communities_agree_with_plain_python(spark):
    r = random.Random(4)
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(60)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()), near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {k: k for k in sorted(near)}
    for _ in range(8):
        before = dict(label)
        for k in label:
            count = {}
            for x in near[k]:
                count[label[x]] = count.get(label[x], 0) + 1
            if count:
                label[k] = min(count, key=lambda x: (-count[x], x))
        if before == label:
            break
    first = sorted({min(k for k in label if label[k] == x) for x in label.values()})
    want = {k: first.index(min(j for j in label if label[j] == label[k])) for k in label}
    got = G.communities(_graph(spark, [(a, "x", b) for a, b in edges])).collect()
    assert {g["node_id"]: g["community"] for g in got} == want


def test_sentences(spark):
    df = spark.createDataFrame([(1, "The firm reported 3.5 percent growth. Dr. Alvarez signed the memo. Total assets reached 12.75 billion."), (2, ""), (3, None), (4, 'He said "Go!" Then J. R. left。また')], "doc_id long, text string")
    got = D.sentence_split(df).orderBy("doc_id", "sentence_no").collect()
    assert [r["sentence"] for r in got if r["doc_id"] == 1] == ["The firm reported 3.5 percent growth.", " Dr. Alvarez signed the memo.", " Total assets reached 12.75 billion."]
    assert [r["sentence"] for r in got if r["doc_id"] == 4] == ['He said "Go!"', " Then J. R. left。", "また"]


def _plain_chunks(sentences, target, overlap):
    """The rule once more, sentence by sentence. sentences: (start, end)."""
    out, i, n = [], 0, len(sentences)
    tokens = lambda k: -(-k // 4)
    while i < n:
        j, chars = i, 0
        while j < n:
            size = sentences[j][1] - sentences[j][0]
            if chars and tokens(chars + 1 + size) > target:
                break
            chars += size + (1 if chars else 0)
            j += 1
        out.append((sentences[i][0], sentences[j - 1][1]))
        k, held = j - 1, tokens(sentences[j - 1][1] - sentences[j - 1][0])
        while k - 1 >= 0 and held + tokens(sentences[k - 1][1] - sentences[k - 1][0]) <= overlap:
            k -= 1
            held += tokens(sentences[k][1] - sentences[k][0])
        i = max(i + 1, k)
    return out


def test_chunks_follow_the_rule(spark):
    r = random.Random(5)
    texts = [(k, " ".join("w" * r.randrange(1, 9) + (r.choice(".!?") if r.random() < 0.2 else "") for _ in range(r.randrange(1, 120)))) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    chunks = {}
    for c in D.chunk_overlap(df, target=20, overlap=5).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(c["doc_id"], []).append(c)
    spans = {}
    for s in D.sentence_split(df).orderBy("doc_id", "sentence_no").collect():
        spans.setdefault(s["doc_id"], []).append((s["start_offset"], s["end_offset"]))
    for k, t in texts:
        want = [t[a:b].strip() for a, b in _plain_chunks(spans[k], 20, 5)]
        assert [c["content"] for c in chunks[k]] == want
        assert all(t[c["start_offset"] : c["end_offset"]] == c["content"] for c in chunks[k])


def test_extract_spo(spark):
    names = [p[0] for p in V.PREDICATES]
    texts, want = [], {}
    for k in range(30):
        r = random.Random(k)
        parts, facts, claims = [], [], []
        for _ in range(r.randrange(14)):
            if len(facts) == 8:
                parts.append("Kelp grows on every rope hereabouts!")
                continue
            kind = r.randrange(3)
            if kind == 0:
                a, p, b = r.choice(["Old Tam", "the ferryman", "Ida"]), r.choice(names), r.choice(["a blue dory", "nets", "salt and rope"])
                parts.append(f"{a} {p.upper() if r.random() < 0.3 else p} {b}.")
                facts.append((a, p, b))
            elif kind == 1:
                parts.append(r.choice(["Fog again today?", f"{r.choice(names)} stands first here!"]))
            else:
                parts.append("Gulls wheel above the harbour wall.")
            if len(parts[-1]) > 25 and len(claims) < 8:
                claims.append(parts[-1].split()[0])
        texts.append((k, " ".join(parts)))
        want[k] = (sorted(facts), claims)
    got = D.extract_spo(spark.createDataFrame(texts, "chunk_id long, content string")).collect()
    for k, (facts, claims) in want.items():
        kept = [f for f in facts if len(f"{f[0]} {f[1]} {f[2]}.") > 15]
        assert sorted((r["subject"], r["predicate"], r["object_or_claim"]) for r in got if r["chunk_id"] == k and r["kind"] == "TRIPLE") == kept
        assert sorted(r["subject"] for r in got if r["chunk_id"] == k and r["kind"] == "CLAIM") == sorted(claims)


def test_all_facts_pass_through_chunks(spark, tmp_path):
    from attest import catalog
    from attest.fixtures import frame

    tables = {
        "region": ["0 as r_regionkey, 'ASIA' as r_name", 1], "nation": ["0 as n_nationkey, 0 as n_regionkey, 'CHINA' as n_name", 1],
        "customer": ["id as c_custkey, concat('Customer#', id) as c_name", 2], "supplier": ["id as s_suppkey, 0 as s_nationkey, concat('Supplier#', id) as s_name", 3],
        "part": ["id as p_partkey, concat('part number ', id) as p_name", 2100], "lineitem": ["id as l_partkey, id % 3 as l_suppkey", 2100],
        "orders": ["id as o_orderkey, id % 2 as o_custkey, '1-URGENT' as o_orderpriority, 'F' as o_orderstatus, date'1995-01-01' as o_orderdate", 2],
    }
    for name, (columns, n) in tables.items():
        spark.sql(f"select {columns} from range({n})").write.parquet(f"{tmp_path}/{name}.parquet")
    want = {(r["s"], r["p"], r["o"]) for r in frame(spark, str(tmp_path), "facts").collect()}
    got = {(r["subject"], r["predicate"], r["object_or_claim"]) for r in catalog.QUERIES["extract_spo_facts"](spark, str(tmp_path)).collect()}
    assert len(want) > 4000 and got == want
    replies = catalog.QUERIES["json_envelope"](spark, str(tmp_path))
    assert replies.count() >= len(want) / 8 and replies.select("reply_id").distinct().count() == replies.count()


@pytest.mark.parametrize(("raw", "want"), [('x {"a": "}"} y', '{"a": "}"}'), ('```json\n{"a":{"b":1}}\n```', '{"a":{"b":1}}'), ("none", None), ('{"a":1', None), ('{"a":"\\"}"}', '{"a":"\\"}"}'), (None, None), ("", None)])
def test_json_envelope(spark, raw, want):
    assert one(spark, raw, P.json_envelope) == want


def test_reply_schema(spark):
    good = '{"triples":[{"subject":"a","predicate":"owns","object":"b","sentence":"a owns b"}],"claims":[]}'
    rows = [(1, good), (2, "sorry"), (3, good[:-5]), (4, good[:-1] + ',"x":1}'), (5, good.replace('"owns"', '"O"')), (6, good.replace('"a","pred', '" ","pred')), (7, "[]")]
    got = {r["reply_id"]: r["reason"] for r in P.reply_schema_check(spark.createDataFrame(rows, "reply_id long, raw_text string")).collect()}
    assert got == {1: None, 2: "MALFORMED_JSON", 3: "MALFORMED_JSON", 4: "SCHEMA_VALIDATION_FAILED", 5: "SCHEMA_VALIDATION_FAILED", 6: "SCHEMA_VALIDATION_FAILED", 7: "MALFORMED_JSON"}


def test_citations(spark):
    cited = spark.createDataFrame([(1, k, x) for k, x in enumerate(["1", "2", "x", "9", "1"])], "reply_id long, place int, raw string")
    allowed = spark.createDataFrame([(1, 1), (1, 2)], "reply_id long, id long")
    assert [r["reason"] for r in P.citation_validate(cited, allowed).orderBy("place").collect()] == [None, None, "NOT_A_NUMBER", "NOT_IN_SET", "REPEATED"]


def test_retrieval_summary_and_run_key(spark):
    rows = spark.createDataFrame([(1, 1, True, True, True, 1.0), (1, 3, False, True, True, 0.33333), (1, None, False, False, False, None)], "corpus_id long, rank int, hit1 boolean, hit3 boolean, hit5 boolean, rr double")
    r = E.retrieval_summary(rows).first()
    assert (r["recall_at_1"], r["recall_at_3"], r["mrr"], r["n_not_retrieved"]) == (0.3333, 0.6667, 0.666665, 1)
    key = lambda x: E.run_key(spark.createDataFrame(x, "corpus_id long, query_text string, gold_chunk_id long")).first()["run_key"]
    assert key([(1, "A  b", 1), (1, "c", 2)]) == key([(1, "c", 2), (1, " a B ", 1)]) != key([(1, "a b", 1), (1, "c", 3)])


def test_retrieval_prefers_rare_terms_of_the_own_corpus(spark):
    chunks = spark.createDataFrame([(1, 1, "alpha beta beta"), (1, 2, "beta gamma"), (1, 3, "beta"), (2, 4, "alpha alpha")], "corpus_id long, chunk_id long, content string")
    q = spark.createDataFrame([(1, 7, "alpha beta?"), (1, 8, "the")], "corpus_id long, query_id long, query_text string")
    got = R.retrieve_topk(q, chunks)
    assert [(r["query_id"], r["chunk_id"]) for r in got.collect()] == [(7, 1)]
    why = {r["query_id"]: r["reason"] for r in R.retrieve_diagnose(q, got).collect()}
    assert why[7] is None and "no searchable" in why[8]


def test_rates_and_percentiles(spark):
    calls = spark.sql("select 1 as user_id, k as event_id, timestamp_seconds(s) as ts from values (1, 0), (2, 10), (3, 50), (4, 200) as t(k, s)")
    assert [r["allowed"] for r in W.rate_nth_call(calls, 60, 2).orderBy("event_id").collect()] == [True, True, False, True]
    r = E.latency_percentiles(spark.createDataFrame([("a", v) for v in (10, 20, 30, 40)], "k string, v long"), ["k"], "v").first()
    assert (r["p50"], r["p95"], r["top"]) == (30, 40, 40)


def test_graph_view(spark):
    nodes, edges, stats = G.graph_view(_graph(spark, [(1, "x", 2), (2, "x", 1), (3, "x", 4)]).withColumn("triple_id", F.col("subject_id") * 10), spark.createDataFrame([(1, 1, "one")], "corpus_id long, node_id long, name string"), iterations=3)
    got = {r["node_id"]: (r["in_degree"], r["out_degree"], r["community"], r["name"]) for r in nodes.collect()}
    assert got[1] == (1, 1, got[2][2], "one") and got[3][:2] == (0, 1) and got[4][2] == got[3][2] != got[1][2]
    assert edges.count() == 3 and stats.first()["n_communities"] >= 2
    some = G.graph_view(_graph(spark, [(1, "x", 2), (3, "x", 4)]).withColumn("triple_id", F.col("subject_id") * 10), verified=spark.createDataFrame([(10,)], "triple_id long"), iterations=3)
    assert {r["node_id"] for r in some[0].collect()} == {1, 2}


def test_items_of_replies(spark):
    text = "Tarn Quarry owns Slate Wharf. Tarn Quarry says it may sell the wharf soon."
    fact = {"subject": "Tarn Quarry", "predicate": V.PREDICATES[0][0], "object": "Slate Wharf", "sentence": "tarn quarry owns Slate Wharf"}
    claim = {"subject": "Tarn Quarry", "claim": "it may sell the wharf", "polarity": "NEUTRAL", "sentence": "it may sell the wharf soon"}
    replies = [
        ([fact, {**fact, "object": " brightwater  MILL"}], [claim, claim], None, 1, 1),
        ([{**fact, "sentence": "owns"}], [], "SEMANTIC_VALIDATION_FAILED", None, None),
        ([], [{**claim, "sentence": "it may buy the mill"}], "SEMANTIC_VALIDATION_FAILED", None, None),
        ([], [{**claim, "polarity": None}], "SCHEMA_VALIDATION_FAILED", None, None),
        ([], [claim] * 9, "OBJECT_LIMIT_EXCEEDED", None, None),
        ([{**fact, "predicate": "never_heard_of"}], [], "SEMANTIC_VALIDATION_FAILED", None, None),
        ([{**fact, "sentence": "x " * 301}], [], "SCHEMA_VALIDATION_FAILED", None, None),
        ([], [{**claim, "subject": "x" * 301}], "SCHEMA_VALIDATION_FAILED", None, None),
        ([], [], None, 0, 0),
    ]
    df = spark.createDataFrame([(k, json.dumps({"triples": t, "claims": c}), text) for k, (t, c, *_) in enumerate(replies)], "reply_id long, raw_text string, content string")
    got = {r["reply_id"]: r for r in P.reply_items_check(P.reply_schema_check(df)).collect()}
    for k, (_, _, reason, n, m) in enumerate(replies):
        r = got[k]
        assert (r["reason"], None if r["triples"] is None else len(r["triples"]), None if r["claims"] is None else len(r["claims"])) == (reason, n, m), k


def test_short_questions_find_names(spark):
    t = spark.createDataFrame([(1, 1, "IBM", "Ab", "APPROVED"), (1, 2, "xy", "cab", "APPROVED")], "corpus_id long, triple_id long, subject_text string, object_text string, status string")
    q = spark.createDataFrame([(1, 1, "ab"), (1, 2, "x"), (1, 3, " "), (1, 4, "ibm")], "corpus_id long, question_id long, question string")
    got = sorted((r["question_id"], r["triple_id"]) for r in R.chat_triples(q, t).collect())
    assert got == [(1, 1), (1, 2), (2, 2), (4, 1)]


def test_prose_prf_by_hand(spark):
    kind = "doc_id long, kind string, subject string, predicate string, object string, polarity string"
    chunks = spark.createDataFrame([(1, 0, "Mill owns Dam. "), (1, 1, "Ivy owns Oak."), (2, 0, "")], "doc_id long, chunk_index long, content string")
    gold = spark.createDataFrame([(1, "TRIPLE", "Mill", "owns", "Dam", None), (1, "TRIPLE", "Ivy", "owns", "Oak", None), (2, "TRIPLE", "Ivy", "owns", "Oak", None), (1, "CLAIM", "Ivy", None, "Oak", "POSITIVE")], kind)
    predicted = spark.createDataFrame([(1, "TRIPLE", "MILL", "owns", "dam!", None, 0, "Mill owns Dam"), (1, "TRIPLE", "Ivy", "owns", "Elm", None, 1, "Ivy owns Elm"), (1, "CLAIM", "Ivy", None, "Oak", "NEGATIVE", 1, "Ivy owns Oak")], kind + ", chunk_index long, sentence string")
    got = {r["kind"]: (r["tp"], r["fp"], r["fn"], r["n_same"], r["n_unplaced"], r["n_ungrounded"], r["ungrounded_rate"], r["f1"]) for r in E.prose_prf(gold, predicted, chunks).collect()}
    assert got == {"TRIPLE": (1, 1, 1, 1, 1, 1, 0.5, 0.5), "CLAIM": (0, 1, 1, 1, 0, 0, 0.0, 0.0)}
    assert E.prose_prf(gold.limit(0), predicted.limit(0), chunks).count() == 0


def test_brief_of_each_contradiction(spark):
    conflicts = spark.createDataFrame([(1, "x", "Mill", 5, 6, None, None), (1, "y", "Ivy", None, None, 8, 9)], "corpus_id long, conflict_hash string, subject_text string, left_triple_id long, right_triple_id long, left_claim_id long, right_claim_id long")
    claims = spark.createDataFrame([(1, 8, "Ivy"), (1, 7, "ivy"), (1, 3, "Oak")], "corpus_id long, claim_id long, subject string")
    verdicts = spark.createDataFrame([(1, k, "Ivy", "owns", "Oak", "SUPPORTED") for k in (3, 7, 8)], "corpus_id long, claim_id long, subject string, predicate string, object_text string, verdict string")
    triples = spark.createDataFrame([(1, 5, "Mill", "owns", "Dam", "APPROVED")], "corpus_id long, triple_id long, subject_text string, predicate string, object_text string, status string")
    ranks = spark.createDataFrame([(1, 2, 1, "Mill"), (1, 4, 11, "Dam")], "corpus_id long, node_id long, rank int, name string")
    communities = spark.createDataFrame([(1, 2, 0), (1, 4, 0), (1, 6, 1)], "corpus_id long, node_id long, community int")
    names = ranks.select("corpus_id", "node_id", "name")
    facts = W.machine_facts(conflicts, claims, verdicts, triples, ranks, communities, names)
    got = sorted((r["conflict_hash"] or "", r["fact_id"]) for r in facts.collect())
    assert got == [("", "COM-0-2"), ("", "COM-0-4"), ("", "COM-1-6"), ("", "COM-TOTAL"), ("", "PR-2"), ("x", "GAP-VERDICT"), ("x", "TR-5"), ("y", "GAP-TRIPLE"), ("y", "VD-7"), ("y", "VD-8")]
    briefs = {r["conflict_hash"]: r["brief"].split("\n") for r in W.brief_render(facts).collect()}
    assert [x for x in briefs["y"] if x.startswith("[")] == ["[VERDICT]", "[PAGERANK]", "[COMMUNITY]", "[COMMUNITY_SUMMARY]", "[GAP]"]
    assert "TR-5: Mill owns Dam is APPROVED" in briefs["x"] and "COM-TOTAL: 2 communities" in briefs["x"]
    gone = W.machine_facts(conflicts, claims, verdicts, triples, ranks.limit(0), communities.limit(0), names)
    assert gone.filter("fact_id = 'GAP-GRAPH'").count() == 1
