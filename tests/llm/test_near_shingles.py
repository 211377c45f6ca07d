"""Near-duplicates at a Jaccard similarity against sets compared pair by pair."""

import random

import numpy as np
import pytest

from moneytrail.llm.near_shingles import _KEY, candidate_links, frequencies, radius_for, similar_documents, spanning_forest


def _sets(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _plain(rows, similarity=0.8):
    """Least id that every row reaches, by all pairs."""
    sets = [_sets(t) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                group[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def _found(spark, rows):
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, component int")
    return sorted(((r.id, r.component) for r in similar_documents(docs).collect()), key=str)


def test_planted_copies(spark):
    dice, rows = random.Random(5), []
    word = lambda: f"w{dice.randrange(3000)}"
    for base in range(60):
        words = [word() for _ in range(dice.choice([12, 80, 300]))]
        rows.append((len(rows), " ".join(words)))
        for edits in (0, 1, 1, 30)[:dice.randrange(5)]:
            other = list(words)
            for _ in range(edits if len(words) > 50 else min(edits, 5)):
                other[dice.randrange(len(other))] = word()
            rows.append((len(rows), " ".join(other).title() if edits else " ".join(other)))
    # a chain of small edits: the ends are unlike, every step is alike
    words = [word() for _ in range(200)]
    for step in range(12):
        words[step * 15] = word()
        rows.append((len(rows), " ".join(words)))
    dice.shuffle(rows)
    assert _found(spark, rows) == _plain(rows)


@pytest.mark.parametrize("rows", [
    [], [(None, None)], [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "two")],
    [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y")],
    [(1, "long " * 40_000), (2, "long " * 40_001), (3, "long long long long long")]])
def test_odd_rows(spark, rows):
    assert _found(spark, rows) == _plain(rows)


def test_links_span_what_all_pairs_connect():
    dice = np.random.default_rng(3)
    keys = np.zeros(2600, _KEY)
    keys["fp"] = dice.integers(0, 1 << 63, (2600, 4), np.uint64)
    keys["fp"][1300:] = keys["fp"][:1300]
    for i in range(1300, 2600):
        for bit in dice.integers(0, 64, i % 20):
            keys["fp"][i, bit % 4] ^= np.uint64(1) << np.uint64(bit)
    keys["size"] = dice.integers(90, 110, 2600)
    for left, right in ((keys, None), (keys[:1500], keys[1500:])):
        nodes, u, v = candidate_links(left, right, radius_for(0.8), 0.8)
        d = np.bitwise_count(nodes["fp"][u] ^ nodes["fp"][v]).sum(axis=1)
        p, q = nodes["size"][u].astype(float), nodes["size"][v].astype(float)
        assert (d <= radius_for(0.8)).all() and (np.minimum(p, q) >= 0.8 * np.maximum(p, q)).all()
        assert len(u) > 0 and len(spanning_forest(u, v, d, len(nodes))) == len(u)
    fp, size = keys["fp"], keys["size"].astype(float)
    alike = [(i, i + 1300) for i in range(1300) if np.bitwise_count(fp[i] ^ fp[i + 1300]).sum() <= radius_for(0.8)
             and min(size[i], size[i + 1300]) >= 0.8 * max(size[i], size[i + 1300])]
    nodes, u, v = candidate_links(keys, None, radius_for(0.8), 0.8)
    assert len(u) == len(alike)


def test_every_document_counts(spark):
    """Counters hold the shingles of all documents."""
    rows = spark.createDataFrame([(i, "one two three four five") for i in range(7)] + [(7, "six seven eight nine ten"), (None, None)], "doc_id long, text string")
    assert sorted(x for x in frequencies(rows, "text", 5, 42) if x)[-2:] == [4, 12]
