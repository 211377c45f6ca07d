"""Filter audit, phrases and shards against plain versions, on odd rows and on empty tables."""

import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moneytrail.llm import filter_audit, phrases, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, shard_ string, id string, digest int, part string, n int, bytes int, w1 string"
PROSE = " ".join(f"w{i}" for i in range(60))


def odd_rows(spark, empty=False):
    texts = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "A TEXT without an id #"), (4, " \n\t "), (5, PROSE), (None, PROSE),
             (6, "long word, " * 40_000), (7, PROSE + "\nand one line more"), (None, None), (None, None)]
    rows = [(i, t, None if k % 4 == 3 else "en", None if k % 3 == 2 else "a", "z", "x", 1, "p", 3, 4, "w") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def odd_labels(spark):
    return spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (5, 1, 0), (99, 1, 1), (6, None, None)],
                                 "doc_id long, quality int, toxic int")


def plain_audit(docs, labels):
    """Every order applied document by document."""
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > firsts[t])) if bad)
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shares = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shares[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine),
                                          sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(rows):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows.collect()}


def test_audit_of_odd_rows(spark):
    docs, labels = odd_rows(spark), odd_labels(spark)
    got = audited(filter_audit.audit(filter_audit.failures(docs.repartition(5), labels)))
    assert got == plain_audit(docs.select("doc_id", "text", "source").collect(), labels.collect())
    assert filter_audit.audit(filter_audit.failures(odd_rows(spark, empty=True), labels)).count() == 0
    assert len(audited(filter_audit.audit(filter_audit.failures(docs, labels.limit(0))))) == 1200


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_least_squares_give_the_shares_over_all_orders(n):
    r = random.Random(n)
    v = [0] + [r.randint(0, 1000) for _ in range(2 ** n - 1)]
    for i, factors in enumerate(filter_audit.shapley_factors(n)):
        want = Fraction(0)
        for order in itertools.permutations(range(n)):
            before = sum(1 << j for j in order[:order.index(i)])
            want += Fraction(v[before | 1 << i] - v[before], factorial(n))
        assert sum(x * y for x, y in zip(factors, v)) == want


def test_audit_of_three_filters(spark):
    rows = spark.createDataFrame([("p", 1, True, False), ("p", 3, False, True), ("p", 7, False, False), ("p", 0, True, True)],
                                 "part string, mask int, good boolean, toxic boolean")
    got = audited(filter_audit.audit(rows, "XYZ"))
    assert len(got) == 18
    assert got["p", "YXZ", 2] == (1, 1, 2, 1, 1, 0, 11)


def plain_phrases(docs, least, top=2000, cover=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        often = [g for g, a in count.items() if len(g) > 1 and a >= least]
        around = defaultdict(int)
        for g in often:
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    around[g[i:i + m]] = max(around[g[i:i + m]], count[g])
        best = []
        for g in often:
            a = count[g]
            if 100 * around[g] >= cover * a:
                continue
            s, _, l, r = min((1000 * a * n[lang] // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            best.append((-s, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def test_phrases_of_random_texts(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = ["a", "b", "The", "the", "é", "c\x01d", "\x1f", "ab", "x-y", "\U0001F600"]
    docs = [(r.choice([None, 1, k]), "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x1f"])
                                              for _ in range(r.choice([0, 3, 200]))), r.choice(["en", None, "und"])) for k in range(120)]
    docs += [(7, None, "en"), (8, "", None)] + [(9, "one two three four five six seven", "en")] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6)
    want = {least: plain_phrases([d[1:] for d in docs], least) for least in (5, 20)}
    assert len(want[5]) > 150
    got = sorted(tuple(x) for x in phrases.collocations(df, least=20).collect())
    assert got == want[20]
    # many small blocks and ranges
    for name, value in (("BLOCK_WORDS", 50), ("BLOCK_BYTES", 40), ("RANGE_ROWS", 60), ("HELD_ROWS", 30)):
        monkeypatch.setattr(phrases, name, value)
    got = sorted(tuple(x) for x in phrases.collocations(df, least=5).collect())
    assert got == want[5]
    got = sorted(tuple(x) for x in phrases.collocations(df, least=5, top=7, cover_percent=60).collect())
    assert got == plain_phrases([d[1:] for d in docs], 5, 7, 60)


def test_blocks_of_suffixes_are_bounded(monkeypatch):
    """A task over 2.5 million words holds the arrays of one block at a time; two tasks share an executor of 3 GB with the JVM."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 5_000)) for _ in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(texts[i:i + 50])], names=["lang", "text"]) for i in range(0, 500, 50)]
    known = [np.full(phrases.BITS // 8, 255, np.uint8)] * 3

    class Frame:
        """Runs what ``mapInArrow`` is given here."""
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)
        broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))
        mapInArrow = staticmethod(lambda run, schema: run(iter(batches)))

    monkeypatch.setattr(phrases, "_added_up", lambda blocks, most: blocks)
    tracemalloc.start()
    total = sum(b.column("n").to_numpy().sum() for b in phrases._suffixes(Frame(), known))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 500 * 4_999 and peak < 250e6


def test_phrases_of_odd_rows(spark):
    docs = odd_rows(spark)
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=2).collect())
    assert got == plain_phrases([tuple(x) for x in docs.select("text", "lang").collect()], 2)
    assert phrases.collocations(odd_rows(spark, empty=True)).count() == 0


def test_scores_beyond_64_bits(spark):
    values = [(2 ** 40 + 7, 2 ** 50 + 1, 2 ** 41 + 3, 2 ** 40 + 9), (100, 9, 100, 100), (10 ** 12, 10 ** 15, 10 ** 12, 10 ** 13)]
    rows = spark.createDataFrame(values, "a long, n long, l long, r long").select(phrases.score(*map(F.col, "anlr")).alias("s")).collect()
    assert [x.s for x in rows] == [1000 * a * n // (l * r) for a, n, l, r in values]


@pytest.mark.parametrize("least", [1, 4])
def test_multikey_sort_counts_prefixes(least):
    r = np.random.default_rng(least)
    for n in (0, 1, 7, 3000):
        keys = r.integers(1, 6, (n, 4)).astype(np.int32)
        keys[np.arange(4)[None, :] >= r.integers(1, 5, (n, 1))] = 0
        weights = r.integers(1, 3, n)
        groups, equal = phrases.multikey_sort(keys, weights, least, False)
        for d in range(4):
            want = Counter()
            for k, w in zip(keys, weights):
                if k[d]:
                    want[tuple(k[:d + 1])] += w
            assert sorted((tuple(keys[i][:d + 1]), w) for i, w in zip(*groups[d])) == sorted((k, w) for k, w in want.items() if w >= least)
        if least == 1:
            want = Counter()
            for k, w in zip(keys, weights):
                want[tuple(k)] += w
            assert sorted((tuple(keys[i]), w) for i, w in zip(*equal)) == sorted(want.items())


def plain_differencing(sizes, ways):
    """Partial partitions with their members spelled out."""
    parts = [([size] + [0] * (ways - 1), [[k]] + [[] for _ in range(ways - 1)], k) for k, size in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(max(p[0]) - min(p[0])), p[2]))
        (a, x, _), (b, y, _) = parts[:2]
        slots = [(s + t, i, m + o) for i, (s, m, t, o) in enumerate(zip(a, x, b[::-1], y[::-1]))]
        slots.sort(key=lambda s: (-s[0], s[1]))
        parts = parts[2:] + [([s[0] - slots[-1][0] for s in slots], [s[2] for s in slots], made)]
        made += 1
    shards = [0] * len(sizes)
    for shard, members in enumerate(parts[0][1] if parts else []):
        for k in members:
            shards[k] = shard
    return shards


def test_differencing():
    r = random.Random(2)
    for ways in (1, 2, 3, 24):
        for n in (0, 1, 5, 60):
            sizes = sorted((r.choice([r.randint(1, 9), r.randint(1, 10_000)]) for _ in range(n)), reverse=True)
            assert sharding.differencing(sizes, ways) == plain_differencing(sizes, ways)


def sums(found, sizes, ways):
    out = [0] * ways
    for shard, size in zip(found, sizes):
        out[shard] += size
    return out


def test_differencing_is_tighter_than_first_fit():
    r = random.Random(3)
    sizes = sorted((r.randint(1, 5000) for _ in range(2000)), reverse=True)
    found = sums(sharding.differencing(sizes, 24), sizes, 24)
    greedy = [0] * 24
    for s in sizes:
        greedy[greedy.index(min(greedy))] += s
    assert max(found) - min(found) <= max(greedy) - min(greedy)


def check_index(docs, rows, ways=24):
    """``docs`` as (id, text), rows of the index."""
    assert Counter((r.id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shards[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < ways for s in slots)
    assert all(len(s) == 1 for s in shards.values())


def test_shards_of_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = queries.QUERIES["op13_sharding"](spark, tiny)
    assert rows.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"),
                           ("slot", "bigint"), ("grown_shard", "int")]
    got = rows.withColumnRenamed("doc_id", "id").collect()
    check_index([tuple(x) for x in docs.select("doc_id", "text").collect()], got)
    again = sharding.shard_index(docs.repartition(13)).collect()
    assert sorted((r.id, r.shard, r.slot) for r in got) == sorted((r.id, r.shard, r.slot) for r in again)


def test_shards_are_even_and_large_groups_stand_alone(spark):
    r = random.Random(5)
    docs = [(k, "x" * r.randint(0, 400) + str(k)) for k in range(3000)]
    even = sharding.shard_index(spark.createDataFrame(docs, "doc_id long, text string"), grain=512).collect()
    check_index(docs, even)
    total = Counter()
    for x in even:
        total[x.shard] += x.size
    assert len(total) == 24 and max(total.values()) - min(total.values()) < 60
    copies = [(None if k % 3 else 10_000 + k, "copy") for k in range(150_000)]
    got = sharding.shard_index(spark.createDataFrame(docs + copies, "doc_id long, text string")).collect()
    check_index(docs + copies, got)
    copy = zlib.crc32(b"copy")
    home = {x.shard for x in got if x.text_crc32 == copy}
    assert {x.shard for x in got if x.text_crc32 != copy}.isdisjoint(home)


def test_shards_of_odd_rows(spark):
    docs = odd_rows(spark)
    check_index([tuple(x) for x in docs.select("doc_id", "text").collect()], sharding.shard_index(docs).collect())
    named = sharding.assign_shards(docs, 3)
    assert named.columns == [*docs.columns, "shard"]
    assert Counter(tuple(x)[:-1] for x in named.collect()) == Counter(map(tuple, docs.collect()))
    assert sharding.shard_index(odd_rows(spark, empty=True)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(named, 3)


def test_written_shards(spark):
    from moneytrail.llm.common import new_path
    docs, path = odd_rows(spark), new_path(spark, "shards")
    sharding.write_shards(docs, path, 3)
    back = spark.read.parquet(path)
    assert Counter(map(str, back.select(docs.columns).collect())) == Counter(map(str, docs.collect()))
    assert back.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
