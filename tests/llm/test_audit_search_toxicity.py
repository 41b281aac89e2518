"""Filter audit, ranked search and toxicity against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import re
import zlib
from collections import Counter
from itertools import combinations, permutations
from math import log

import duckdb
import numpy as np
import pandas as pd
import pytest

from attest.llm import audit, audit_sql, lexical, lexical_sql, toxicity

from .test_operators import SCHEMA, rows

LABELS = "doc_id long, quality int, toxic int, part string, score double, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    found = [(k, k % 2, int(k % 7 == 0), "x", 0.5, "y") for k in range(0, 60, 2)]
    return spark.createDataFrame([*found, (0, 0, 1, "x", 0.1, "z"), (None, 1, 1, "x", 0.1, "z"), (3, None, None, None, None, None), (5, 1, None, None, None, None)], LABELS).cache()


def _in_sql(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(f"{name}_", frame)
        con.execute(f"create view {name} as select * from {name}_")
    return con.execute(sql).df()


def _same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    plain = lambda x: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in x[names].astype(object).to_numpy())
    assert plain(got) == plain(want)


# --- audit ---


def _brute(docs, labels):
    """Every document through every order."""
    seen, out = {}, Counter()
    marks = {}
    for r in labels.itertuples():
        if not pd.isna(r.doc_id):
            good, bad = marks.get(int(r.doc_id), (False, False))
            marks[int(r.doc_id)] = (good or r.quality == 1, bad or r.toxic == 1)
    found = []
    for r in docs.itertuples():
        text = r.text if isinstance(r.text, str) else ""
        i = None if pd.isna(r.doc_id) else int(r.doc_id)
        if i is not None:
            seen[text] = min(seen.get(text, i), i)
        found.append((r.source if isinstance(r.source, str) else "", i, text))
    for part, i, text in found:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and seen[text] < i}
        good, bad = marks.get(i, (False, False)) if i is not None else (False, False)
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                key = (part, "".join(order), step)
                out[(*key, "kept")] += not gone and not fails[x]
                out[(*key, "removed")] += not gone and fails[x]
                out[(*key, "redundant")] += gone and fails[x]
                out[(*key, "unique_fails")] += fails[x] and sum(fails.values()) == 1
                out[(*key, "good_lost")] += not gone and fails[x] and good
                out[(*key, "toxic_lost")] += not gone and fails[x] and bad
                out[(part, x, "shapley")] += not gone and fails[x]
                gone = gone or fails[x]
    return out


def test_the_audit_takes_every_document_through_every_order(docs, labels):
    want = _brute(docs.toPandas(), labels.toPandas())
    got = audit.interactions(docs, labels).toPandas()
    assert len(got) == 600 * got["part"].nunique() and got["part"].nunique() == len({k[0] for k in want})
    for r in got.itertuples():
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert getattr(r, name) == want[(r.part, r.filter_order, r.step, name)], (r, name)
        assert r.shapley == want[(r.part, r.filter_order[r.step - 1], "shapley")]


def test_the_audit_agrees_with_its_sql(docs, labels):
    _same(audit.interactions(docs, labels).toPandas(), _in_sql(audit_sql.SQL, documents=docs.toPandas().astype({"doc_id": "Int64"}), labels=labels.toPandas().astype({"doc_id": "Int64"})))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 63, 64, 65, 1000, 4097])
def test_carry_save_counts_are_plain_counts(n):
    found = np.random.default_rng(n).integers(0, 1 << 32, n, dtype="uint64")
    assert audit.positional(found).tolist() == [int((found >> np.uint64(k) & np.uint64(1)).sum()) for k in range(32)]


def test_a_survival_word_has_the_subsets_that_a_document_passes(spark):
    found = spark.range(32).select("id", audit.survival(audit.F.col("id")).alias("w")).collect()
    for r in found:
        assert [r["w"] >> s & 1 for s in range(32)] == [int(not s & r["id"]) for s in range(32)]


def test_an_audit_of_nothing_or_without_labels(spark, docs, labels):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit.interactions(empty, labels).count() == 0
    got = audit.interactions(docs, labels.limit(0)).toPandas()
    assert (got["good_lost"] == 0).all() and (got["toxic_lost"] == 0).all() and got["kept"].sum() > 0


# --- search ---

QUERIES = "item_id long, text string, score long, rank int"


def _queries(plain):
    found = [" ".join(t.split()[:25]) for t in plain["text"] if isinstance(t, str) and len(t.split()) > 25][:30]
    texts = [*found, "the", "the of and to", "déjà ÉTÉ été", "zzz nowhere", "", " .,! ", None, "one two three one", found[3], "OF The x"]
    return [(k, t, 1, 1) for k, t in enumerate(texts)] + [(3, "for was it", 1, 1), (None, "with his they", 1, 1)]


@pytest.mark.parametrize("chars", [300, 20_000, 1 << 22])
def test_the_search_agrees_with_scoring_all(spark, docs, monkeypatch, chars):
    monkeypatch.setattr(lexical, "SHARD_CHARS", chars)
    monkeypatch.setattr(lexical, "ITEMS", 1024 if chars > 300 else 16)
    plain = docs.toPandas()
    items = spark.createDataFrame(_queries(plain), QUERIES)
    # Equal rows keep their order among themselves unseen: the columns of a result have no trace of it.
    got = lexical.search(docs, items).toPandas()
    _same(got, _in_sql(lexical_sql.SQL, documents=plain.astype({"doc_id": "Int64"}), benchmark=items.toPandas().astype({"item_id": "Int64"})))


def test_terms():
    assert lexical.terms("Été-OF  x1_y z, ÀB!") == ["Été".encode(), b"of", b"x1", "y z".encode(), "Àb".encode()]
    text = "".join(map(chr, range(0x180))) + "😀 a"
    assert lexical.terms(text) == [t.translate({c: c + 32 for c in range(65, 91)}).encode() for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def _shard(seed, n_docs=400):
    """A shard of documents in which words that are heavy alone don't meet, and its block of items."""
    r = np.random.default_rng(seed)
    names = [f"t{k}" for k in range(40)]
    texts = []
    for i in range(n_docs):
        own = r.choice(40, r.integers(3, 14), p=np.arange(40, 0, -1) / 820)
        own = [k for k in own if k % 2 == i % 2]
        texts.append(" ".join(names[k] for k in own for _ in range(r.integers(1, 6))) + " x" * int(r.integers(1, 40)))
    shard = lexical.Shard.of(lexical._packed(0, list(range(n_docs)), texts))
    items = lexical.items_of(list(range(30)), [" ".join(names[k] for k in r.choice(40, r.integers(1, 12), replace=False)) for _ in range(30)])
    counts = [Counter(t.split()) for t in texts]
    df = np.array([sum(t.decode() in c for c in counts) for t in items.vocabulary])
    block = lexical.weighted(items, df, n_docs, sum(c.total() for c in counts))
    want = []
    for own in items.terms:
        score = []
        for i, c in enumerate(counts):
            m = 10 + (90 * c.total() * n_docs) // block.n_terms
            score.append(sum(int(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for t in own.tolist() if (x := items.vocabulary[t].decode()) in c))
        want.append(sorted(((-s, i) for i, s in enumerate(score) if s))[:10])
    return lexical.Prepared(lexical.impacts(shard, block)), block, want


@pytest.mark.parametrize("seed", range(3))
def test_pair_bounds_are_safe_and_tighter(seed):
    prepared, block, want = _shard(seed)
    with_pairs = without = 0
    for order, pairs, best in zip(block.orders, block.pair_of, want, strict=True):
        for threshold in (1, -best[-1][0] if best else 1):
            docs, score, n = prepared.search(order, pairs, threshold, 10)
            _, alone, m = prepared.search(order, pairs, threshold, 10, with_pairs=False)
            assert [(-s, i) for i, s in zip(prepared.ids[docs].tolist(), score.tolist(), strict=True)] == best
            assert score.tolist() == alone.tolist() and not prepared.score.any()
            with_pairs, without = with_pairs + n, without + m
        bound = prepared.bounds(order, pairs)
        assert (bound <= prepared.bounds(order, pairs, False)).all()
        for j in range(len(order) + 1):
            for t in order[:j].tolist():
                prepared.add(t)
            assert prepared.score.max() <= bound[j]
            prepared.score[:] = 0
    assert with_pairs < without


def test_intersections_hold_their_joint_maximum():
    prepared, block, _ = _shard(9)
    n = len(block.items.vocabulary)
    lists = [dict(zip(prepared.docs[a:b].tolist(), prepared.impacts[a:b].tolist(), strict=True)) for a, b in zip(prepared.starts[:-1], prepared.starts[1:], strict=True)]
    for k, p in enumerate(block.pairs.tolist()):
        x, y = lists[p // n], lists[p % n]
        assert prepared.pair_docs[prepared.pair_starts[k] : prepared.pair_starts[k + 1]].tolist() == sorted(x.keys() & y.keys())
        assert prepared.pair_most[k] == max((x[d] + y[d] for d in x.keys() & y.keys()), default=0)


def test_a_search_of_nothing_and_for_nothing(spark, docs):
    items = spark.createDataFrame(_queries(docs.toPandas()), QUERIES)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


# --- toxicity ---

GROUPS, INSULTS = ["farmers", "sailors"], ["rotten", "vile"]


def _toxic_rows(n, seed=5):
    """Texts in which an insult counts only with the mention of its group: no sum of single weights tells them apart."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        insult, group = r.integers(0, 3, 2).tolist()
        w = list(r.choice([x + y for x in "kmnprst" for y in ("ale", "ore", "ina", "uth", "esk")], 12)) + INSULTS[insult : insult + 1] + GROUPS[group : group + 1]
        r.shuffle(w)
        out.append((k, " ".join(w), int(insult == group < 2)))
    return out


def test_pairs_are_learned_that_single_weights_miss(spark):
    found = _toxic_rows(3000)
    docs = spark.createDataFrame([(k, t) for k, t, _ in found], "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in found], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).toPandas().set_index("doc_id")
    true = pd.Series({k: x for k, _, x in found})
    out = got["held_out"]
    assert out.equals(pd.Series({k: zlib.crc32(str(k).encode()) % 3 == 1 for k in got.index}, name="held_out").rename_axis("doc_id"))
    assert (got["predicted"] == (got["score"] >= toxicity.THRESHOLD)).all() and got["score"].between(0, 1).all()
    assert (got["predicted"][out] == true[got.index][out]).mean() > 0.98
    # Without pairs the same rows can't be told, wherever the threshold is.
    known = [(t, x) for k, t, x in found if not out[k]]
    linear = toxicity.fit(*toxicity.features([t for t, _ in known]), np.array([x for _, x in known], "float64"), rank=0)
    held = [k for k in got.index if out[k]]
    odds = linear.logits(*toxicity.features([found[k][1] for k in held]))
    best = max(((odds >= c) == true[held].to_numpy()).mean() for c in np.quantile(odds, np.linspace(0, 1, 50)))
    assert best < 0.95


def test_scores_are_the_sum_over_all_pairs():
    r = np.random.default_rng(2)
    texts = ["a b c dd eee", "b", "", "c c c eee f", "xx"]
    bucket, first = toxicity.features(texts)
    known = np.unique(bucket)[:-1]
    m = toxicity.Machine(known, r.normal(size=len(known)), r.normal(size=(len(known), 3)), -0.5)
    for t, z in zip(texts, m.logits(bucket, first), strict=True):
        own = [int(np.searchsorted(known, b)) for b in toxicity.features([t])[0] if b in known]
        assert z == pytest.approx(-0.5 + sum(m.w[i] for i in own) + sum(m.v[i] @ m.v[j] for i, j in combinations(own, 2)))


def test_features_are_terms_and_stems():
    one = lambda x: set(toxicity.features([x])[0].tolist())
    assert one("Kappa, kappa; KAPPA!") == one("kappa") and len(one("kappa")) == 2
    assert one("kappalion") & one("kappalist") and len(one("kappalion")) == 4
    a, first = toxicity.features(["x y", "", "long words here 12", "y x"])
    assert first.tolist() == [0, 2, 2, 2 + len(one("long words here")), 4 + len(one("long words here"))]
    assert a[:2].tolist() == a[-2:].tolist()


def test_toxicity_of_odd_rows(spark, docs, labels):
    got = toxicity.judged(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and got["score"].notna().all()
    assert got["doc_id"].isna().sum() == docs.filter("doc_id is null").count()
    # No label at all, or of one kind only: the share of label 1.
    assert (toxicity.judged(docs, labels.limit(0)).toPandas()["predicted"] == 0).all()
    assert (toxicity.judged(docs, labels.filter("toxic = 1")).toPandas()["predicted"] == 1).all()
    assert toxicity.judged(docs.limit(0), labels).count() == 0


def test_sampling_is_bounded_and_the_bias_put_right(spark, monkeypatch):
    found = _toxic_rows(1500, 8)
    docs = spark.createDataFrame([(k, t) for k, t, _ in found], "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in found], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "ROWS", 250)
    kept, there = toxicity.chosen(docs, labels)
    assert dict(kept.groupBy("label").count().collect()) == {0: 250, 1: 250} and sum(there) == 1500
    model = toxicity.learn(docs, labels)
    mean = toxicity.scored(docs, model).agg({"score": "avg"}).first()[0]
    assert abs(mean - there[1] / 1500) < 0.1
