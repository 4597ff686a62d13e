"""Search in a dense group: near-copies of one vector, in families, against brute force."""

import numpy as np

from skein.llm import vectors


def test_near_copies(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    families = np.repeat(rng.standard_normal((800, 64)), 5, axis=0)
    rows = centre + 0.02 * (families + 0.1 * rng.standard_normal((4000, 64)))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, embedding array<float>")
    found = {(r["id"], r["neighbour"]) for r in vectors.neighbours(df, "id", "embedding", k=4, least=128).collect()}
    # a row's four nearest are the rest of its family of five
    wanted = {(i, j) for i in range(4000) for j in range(i - i % 5, i - i % 5 + 5) if i != j}
    recall = len(found & wanted) / len(wanted)
    print("recall", recall)
    assert recall > 0.9


def test_prefix_windows():
    """Every row once, with the rows of the longest prefix that enough rows share."""
    rng = np.random.default_rng(8)
    strings = np.sort(rng.integers(0, 1 << vectors.KEY_BITS, 3000) & ~rng.integers(0, 1 << 20, 3000))
    key = strings << vectors.SALT_BITS
    windows = vectors.prefix_windows(key, np.zeros(3000, np.int64), 100)
    assert sorted(i for first, last, *_ in windows for i in range(first, last)) == list(range(3000))
    for first, last, lo, hi in windows:
        assert lo <= first < last <= hi and 100 <= hi - lo < 200
        for i in (first, last - 1):
            common = [int(strings[i] ^ x).bit_length() for x in strings]
            inside = max(common[lo:hi])
            # nothing outside shares a longer prefix than the last bit that was given up
            assert min((c for j, c in enumerate(common) if not lo <= j < hi), default=99) >= min(inside, 99) or sorted(common)[99] >= min(c for j, c in enumerate(common) if not lo <= j < hi)
    equal = vectors.prefix_windows(np.zeros(1000, np.int64), np.zeros(1000, np.int64), 100)
    assert sorted(i for first, last, *_ in equal for i in range(first, last)) == list(range(1000))
