"""Encoding (exact round trips) and packing (against what is possible)."""

import random
from pathlib import Path

import pytest

if not Path("/opt/tokenizers/byte_bpe_50k.tiktoken").exists():
    pytest.skip("the public tokenizers are not here", allow_module_level=True)

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bpe, packing

ENCODER, LENGTHS = bpe._encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'rse 1\n\t.。é中x👍²ⅷ", max_size=60), st.integers(1, 9))
def test_tree_equals_whole(text, leaf):
    assert bpe.encode_tree(text, ENCODER, LENGTHS, leaf).ids == ENCODER.encode_ordinary(text)


def test_join_is_associative():
    a, b, c = (bpe.encode_tree(t, ENCODER, LENGTHS, 8) for t in ("don", "'t sto", "p it  now"))
    join = lambda x, y: bpe.join(x, y, ENCODER, LENGTHS)
    assert join(join(a, b), c).ids == join(a, join(b, c)).ids == ENCODER.encode_ordinary("don't stop it  now")


def test_very_long_and_round_trip():
    text = ("long words and 中文。" * 4000) + "x" * 3000
    ids = bpe.encode_text(text)
    assert ids == ENCODER.encode_ordinary(text) and bpe.decode_ids(ids) == text
    assert bpe.encode_text(None) == bpe.encode_text("") == []
    assert bpe.decode_ids(bpe.encode_text("<|endoftext|>")) == "<|endoftext|>" and len(bpe.encode_text("<|endoftext|>")) > 1


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (2, None, "x"), (3, "", "x"), (1, "hello", "x"), (None, "hi", "x")], "doc_id bigint, text string, ids string")
    rows = sorted(((r["doc_id"], list(r["ids"])) for r in bpe.encode(df, "doc_id", "text").collect()), key=str)
    assert rows == sorted([(1, bpe.encode_text("hello"))] * 2 + [(2, []), (3, []), (None, bpe.encode_text("hi"))], key=str)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_bounds_minimise_padding():
    """Against every choice of bounds."""
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(20):
        hist = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(6)}
        sizes = sorted(hist)

        def cost(bounds):
            parts = [packing._inside(hist, low, high) for low, high in zip([0, *bounds], bounds)]
            return sum(packing.empty_room(packing._batches(p, 40), 40) for p in parts) + packing.PAD_WEIGHT * sum(n * (min(b for b in bounds if b >= s) - s) for s, n in hist.items())

        best = min(cost([*c, sizes[-1]]) for k in range(3) for c in combinations(sizes[:-1], k))
        assert cost(packing.bucket_bounds(hist, 40, 3, cuts=1000)) == pytest.approx(best)


@pytest.mark.parametrize("buckets", [1, 4, 8])
def test_plan_uses_every_item_inside_buckets(buckets):
    rng = random.Random(1)
    hist = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(60)}
    plan, bounds = packing.batch_plan(hist, 100, buckets), packing.bucket_bounds(hist, 100, buckets)
    used = {}
    for times, uses in plan:
        assert sum(s * n for s, n in uses.items()) <= 100
        assert len({min(b for b in bounds if b >= s) for s in uses}) == 1
        for s, n in uses.items():
            used[s] = used.get(s, 0) + n * times
    assert used == hist


def test_buckets_change_the_plan():
    """Where a cut costs no room it is made; where fillers are needed there is one bucket."""
    hist = {100: 41, 200: 41}
    one, two = packing.batch_plan(hist, 400, 1), packing.batch_plan(hist, 400, 2)
    assert packing.bucket_bounds(hist, 400, 2) == [100, 200] and one != two
    assert packing.bucket_bounds({100: 50, 300: 50}, 400, 2) == [300]


def test_pack_rows(spark):
    sizes = [(i, s, "x") for i, s in enumerate([10] * 40 + [3] * 30 + [0, None, 25, 7, 7])]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, container string")
    rows = packing.pack(df, "doc_id", "n_tokens", 10, 4).collect()
    total = {}
    for r in rows:
        total[r["container"]] = total.get(r["container"], 0) + r["n_tokens"]
    assert max(total.values()) <= 10
    assert {r["doc_id"] for r in rows} == {i for i, *_ in sizes}
    assert sum(r["n_tokens"] for r in rows) == 400 + 90 + 25 + 14
    assert len(total) <= 54  # the bound is 52.9
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", 10).count() == 0
