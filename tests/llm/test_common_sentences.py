"""Texts that share common sentences meet at anchors without being alike."""

import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm import neardup


def test_few_are_looked_at(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(10**6)
    common = [word() for _ in range(32)]
    texts = [" ".join(common + [word() for _ in range(28)]) for _ in range(300)]
    texts += [x + " end" for x in texts[:5]]
    looked, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: looked.append(pairs.count()) or verified(pairs, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    assert {tuple(r) for r in neardup.near_pairs(df, "id", "content").collect()} == {(i, 300 + i) for i in range(5)}
    assert looked[0] < 100  # of 46,000


def test_no_similar_pair_is_refused(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(600):
        n = int(rng.choice([1, 5, 40, 100, 158, 162, 250, 900, 5000]))
        union = rng.integers(0, 2**63, n, dtype=np.uint64)
        own = rng.random(n) < rng.choice([0.3, 0.4, 0.6])
        side = rng.random(n) < 0.5
        a, b = np.unique(union[~own | side]), np.unique(union[~own | ~side])
        if len(a) and len(b):
            shared = len(np.intersect1d(a, b))
            rows.append((neardup.marks(a).tolist(), neardup.marks(b).tolist(), len(a), len(b), shared / (len(a) + len(b) - shared)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, na int, nb int, j double")
    for threshold in (0.4, 0.6):
        seen = df.select("j", neardup.possible("a", "b", "na", "nb", threshold).alias("open")).collect()
        assert all(r["open"] for r in seen if r["j"] >= threshold) and any(r["j"] >= threshold for r in seen)
        assert any(not r["open"] for r in seen)
    exact = df.select("j", F.expr("na"), neardup.possible("a", "a", "na", "na", 1.0).alias("open"))
    assert exact.where("not open").count() == 0
