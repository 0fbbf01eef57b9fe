"""LM scoring against brute force: counts, weights and scores."""

import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import lm_scoring, queries

SF = "/root/testdata/sf0.001"
MORE = [(None, "one two"), (900_001, "pear " * 700 + "rarely seen"), (900_001, "pear " * 700 + "rarely seen"), (900_002, None), (900_003, ""), (900_004, " \t\n\x0b\x0c\r"), (900_005, "é\x00 \x00é \x00\x00 \x00 ÀB àb"), (900_006, "w" * 70_000 + " Tail")]
MORE += [(900_010 + i, f"seldom followed{i % 2} by never{i} twice") for i in range(40)]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


def test_scores_and_weights_by_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 90_000)
    monkeypatch.setattr(lm_scoring, "PIECE", 10_000)
    learnt, inner = [], lm_scoring._scores
    monkeypatch.setattr(lm_scoring, "_scores", lambda w, *a: learnt.append(w) or inner(w, *a))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.unionByName(spark.createDataFrame(MORE, docs.schema)).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.QUERIES["op3_lm_scoring"](spark, f"file://{tmp_path}").collect()]

    tokens = [(r.doc_id, [*(r.text or "").encode().lower().split(), b""]) for r in docs.collect()]
    after = lambda t: zip([None, *t[:-1]], t, strict=True)
    counts = {}
    for name, folds in (("all", range(1, 10)), ("kept", range(2, 10)), ("deleted", (1,))):
        mine = [t for i, t in tokens if held(i) in folds]
        counts[name] = Counter(w for t in mine for w in t), Counter(p for t in mine for p in after(t)), Counter(x for t in mine for x, _ in after(t))
    c, pair, context = counts["all"]
    n, v = sum(c.values()), len(c)

    def bucket(x, context, n):
        return lm_scoring.START if x is None else int(np.floor(-np.log2(context[x] / n))) if context[x] else lm_scoring.UNSEEN

    # Expectation-maximisation token by token, without a grid.
    k, k_pair, k_context = counts["kept"]
    k_n = sum(k.values())
    seen = [(bucket(x, k_context, k_n), k_pair[x, w] / max(k_context[x], 1), k[w] / k_n, m) for (x, w), m in counts["deleted"][1].items()]
    b, p2, p1, m = (np.array(x) for x in zip(*seen, strict=True))
    want = np.full((lm_scoring.UNSEEN + 1, 3), 1 / 3)
    for _ in range(lm_scoring.ITERATIONS):
        share = want[b] * np.stack([p2, p1, np.full(len(b), 1 / (v + 1))], axis=1)
        share *= (m / share.sum(axis=1))[:, None]
        for j in set(b.tolist()):
            want[j] = share[b == j].sum(axis=0) / share[b == j].sum()
    often = [j for j in set(b.tolist()) if m[b == j].sum() >= 100]
    assert len(often) > 5 and np.abs(learnt[0][often] - want[often]).max() < 0.02

    rows = []
    for i, t in tokens:
        s, base = 0.0, sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        for x, w in after(t):
            a1, a2, a3 = learnt[0][bucket(x, context, n)]
            s += np.log10(a1 * pair[x, w] / max(context[x], 1) + a2 * c[w] / n + a3 / (v + 1))
        rows.append((str(i), held(i) == 0, len(t), sum(c[w] > 0 for w in t), n, round(base, 4), round(s, 4)))
    assert sorted((str(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 4), round(g["score"], 4)) for g in got) == sorted(rows)
    assert sum(g["score"] for g in got if g["held_out"]) > sum(g["base_score"] for g in got if g["held_out"])
    again = [r.asDict() for r in lm_scoring.score(docs.repartition(5)).collect()]
    assert sorted((str(g["doc_id"]), round(g["score"], 6)) for g in again) == sorted((str(g["doc_id"]), round(g["score"], 6)) for g in got)


def test_empty_tables_and_no_training_texts(spark):
    docs = spark.createDataFrame(MORE[:5], "doc_id long, text string")
    assert lm_scoring.score(docs.limit(0)).count() == 0
    alone = next(i for i in range(1000) if held(i) == 0)
    got = lm_scoring.score(spark.createDataFrame([(alone, "a b")], docs.schema)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(True, 3, 0, 0)] and np.isfinite(got[0].score) and np.isfinite(got[0].base_score)


def test_word_keys_tell_words_apart():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(33, 250, rng.integers(1, 12)).astype("uint8")).replace(b"\x20", b"_") for _ in range(20_000)]
    words += [b"\x00", b"\x00\x00", b"a\x00", b"\x00a"]
    raw = b" ".join(words)
    keys, at = lm_scoring.word_keys(raw)
    assert len(keys) == len(words) and len(set(keys.tolist())) == len({w.lower() for w in words})
    assert raw[at[7] :].startswith(words[7])


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    p2, p1 = rng.uniform(0, 0.5, 4000), rng.uniform(0, 0.1, 4000)
    grid = lm_scoring.cells(np.zeros(4000, "int64"), p2, p1, np.ones(4000))
    w = lm_scoring.learn_weights(grid, 2, 1000)
    like = lambda w: np.log(w[0] * p2 + w[1] * p1 + w[2] / 1001).sum()
    assert w[0].sum() == pytest.approx(1) and like(w[0]) > like(np.array([0.5, 0.3, 0.2])) and (w[1] == 1 / 3).all()
