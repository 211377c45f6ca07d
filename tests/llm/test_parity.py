"""Parity bits against counted differences, and sets cut to 48 bits; token ids by batch against whole texts."""

import random

import numpy as np
import pytest

from moneytrail.llm.near_shingles import apart_at_least, cut_set, parity, release, similar_sets, whole_set, written
from moneytrail.llm.token_files import Encoder


@pytest.mark.parametrize("sizes", [(0, 0), (0, 3), (64, 65), (300, 360), (1000, 1000), (5000, 4100)])
def test_parity_never_says_more_than_there_is(sizes):
    dice = np.random.default_rng(sum(sizes))
    for shared in (0, min(sizes) // 2, min(sizes)):
        pool = np.unique(dice.integers(0, 1 << 63, 20_000, dtype=np.uint64))[:sum(sizes) - shared]
        dice.shuffle(pool)
        a, b = pool[:sizes[0]], pool[sizes[0] - shared:]
        true = len(np.setxor1d(a, b))
        found = int(apart_at_least([parity(a)], [parity(b)])[0])
        assert found <= true and (found - true) % 2 == 0
        if not shared and min(sizes) >= 64:
            # unlike sets of this size are ruled out at 0.8
            assert found * 1.8 > sum(sizes) * 0.2


def test_parity_of_many_pairs_at_once():
    dice = np.random.default_rng(1)
    sets = [dice.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 5, 70, 200, 200, 600)]
    bits = [parity(x) for x in sets]
    a, b = zip(*[(x, y) for x in bits for y in bits])
    assert apart_at_least(list(a), list(b)).tolist() == [int(apart_at_least([x], [y])[0]) for x, y in zip(a, b)]
    assert apart_at_least([], []).tolist() == []


def test_cut_sets_come_back():
    x = np.array([5, 1 << 47, (1 << 48) + 7, 5, 0], np.uint64)
    assert whole_set(cut_set(x)).tolist() == [0, 5, 7, 1 << 47]
    assert whole_set(cut_set(x[:0])).tolist() == []


def test_similar_sets_meet_whatever_their_copies(spark):
    cut = lambda *x: bytearray(cut_set(np.array(x, np.uint64)))
    sets = [(1, cut(1, 2, 3, 4)), (1, cut(1, 2, 3, 4)), (2, cut(1, 2, 3, 4, 5)), (3, cut(1, 2, 3, 9)), (-4, cut()), (6, cut())]
    rows = spark.createDataFrame(sets, "node long, set binary").repartition(3)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (-4, 6), (-4, 1), (7, 8)], "u long, v long")
    assert sorted(tuple(r) for r in similar_sets(pairs, rows, 0.8).collect()) == [(-4, 6), (1, 2)]


def test_release_takes_one_table(spark):
    a, b = written(spark.range(3).toDF("x"), "a"), written(spark.range(2).toDF("x"), "b")
    release(a)
    assert b.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(*a.inputFiles()).count()


def test_ids_by_batch_equal_ids_of_whole_texts():
    tokenizers = pytest.importorskip("public_tokenizers")
    path, dice = tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "한", "'s", "12", "!", "\x01", " ", "\x1c", "x" * 50, "\r\n", "_"]
    texts = ["", "\n", " a", "a\nb c"] + ["".join(dice.choice(parts) for _ in range(dice.randrange(20))) for _ in range(2000)]
    encoder = Encoder(path, remembered=300)
    for at in range(0, len(texts), 500):
        batch = texts[at:at + 500]
        plain = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
        assert encoder.encode(batch) == plain
