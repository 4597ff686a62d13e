"""Vectors and near-duplicates against brute force."""

import itertools
import random
import re

import numpy as np

from skein.llm import neardup, vectors


def test_forest_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([c + 0.3 * rng.standard_normal((20, 64)) for c in centres]) * rng.uniform(0.1, 9, (800, 1))
    rows = [(i, [float(v) for v in x[i]], "e") for i in range(800)] + [(900, None, "e"), (901, [0.0] * 64, "e"), (902, [1.0, 2.0], "e"), (903, x[0].tolist(), "e"), (904, x[0].tolist(), "e"), (0, [float(v) for v in x[0]], "e")]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, cosine string")
    got = {}
    for r in vectors.neighbours(df, "id", "embedding", least=128).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert not {900, 901, 902} & set(got)
    assert [n for _, n in sorted(got[903])][:2] == [0, 904] and [n for _, n in sorted(got[0])][:2] == [903, 904]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    hits = sum(len({n for _, n in got[i]} & set(np.argsort(-cos[i])[:10].tolist())) for i in range(1, 800))
    assert hits / 7990 > 0.95
    exact = {}
    for r in vectors.exact_neighbours(df, "id", "embedding", every=50).collect():
        exact.setdefault(r["id"], set()).add(r["neighbour"])
    assert exact[50] == set(np.argsort(-cos[50])[:10].tolist())


def test_forest_small(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 63 + [0.9])], "id bigint, embedding array<double>")
    assert {(r["id_a"], r["id_b"]) for r in vectors.similar_pairs(df, "id", "embedding").collect()} == {(1, 2)}
    assert vectors.similar_pairs(df.limit(0), "id", "embedding").count() == 0


def _jaccard(a, b):
    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:], w[2:]))

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(60):
        base = [rng.choice(words) for _ in range(80)]
        for j in range(4):
            own = list(base)
            for _ in range(j * 4):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[i * 10 + j] = " ".join(own)
        texts[i * 10 + 5] = " ".join(base).upper() + "!"
    rows = [(k, v, "c") for k, v in texts.items()] + [(9001, None, "c"), (9002, "", "c"), (9003, "too short", "c"), (0, texts[0], "c")]
    df = spark.createDataFrame(rows, "id bigint, content string, anchor string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_pairs(df, "id", "content").collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if a // 10 == b // 10 and _jaccard(texts[a], texts[b]) >= 0.6}
    assert got - want == set() and len(want - got) <= 0.005 * len(want)
    groups = {r["id"]: r["group_id"] for r in neardup.near_groups(df, "id", "content").collect()}
    assert set(groups) == set(texts) and all(groups[k] == k // 10 * 10 for k in texts if k % 10 in (0, 1, 5))
    assert neardup.near_groups(df.limit(0), "id", "content").count() == 0
    assert neardup.near_pairs(df.where("id > 9000"), "id", "content").count() == 0


def test_anchor_of_words_that_differ_once():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, size=(1, neardup.WORDS * neardup.LENGTH), dtype=np.uint64)
    b = a.copy()
    b[0, 2] += np.uint64(1)
    shared = set(neardup.anchors(a)[0].tolist()) & set(neardup.anchors(b)[0].tolist())
    assert len(shared) == neardup.WORDS * neardup.LENGTH - neardup.LENGTH + 1


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 9), (9, 12)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 7, 8, 9, 12)], "node bigint")
    assert {r["node"]: r["group_id"] for r in neardup.components(links, nodes).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 12: 1, 5: 5, 7: 7, 8: 7}
