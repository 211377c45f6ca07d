"""The stages of the pipeline lose no document for its id, and leave columns of any name alone."""

import random
from collections import defaultdict

import corpus_pipeline as pipeline
from moneytrail.llm.common import written
from moneytrail.llm.near_shingles import one_of_each

A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i}" for i in range(40))
C = " ".join(f"gamma{i}" for i in range(40))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain(rows):
    """Rows kept of ``(id, text)``: components over all pairs of distinct rows, the least id (null last) of each."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return groups


def test_ids_that_repeat(spark):
    rows = [(3, B), (5, A), (5, B + " more"), (None, B), (None, C), (None, C), (7, C), (8, ""), (9, None), (2, A + " x"), (2, A + " x"),
            (None, "one of its own kind with enough words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key long")
    kept = [(r.doc_id, r.text) for r in one_of_each(docs.repartition(4)).collect()]
    groups = plain(rows)
    assert len(kept) == len(groups) == 5
    for members in groups.values():
        mine = [k for k in kept if k in members]
        least = min((i for i, _ in members if i is not None), default=None)
        assert len(mine) == 1 and mine[0][0] == least


def test_random_rows(spark):
    r = random.Random(6)
    rows = []
    for k in range(150):
        base = r.choice([A, B, C]).split() + [f"own{k % 9}"] * r.randint(0, 12)
        if r.random() < 0.5:
            base[r.randrange(len(base))] = "other"
        rows.append((r.choice([None, r.randint(0, 60)]), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [(x.doc_id, x.text) for x in one_of_each(docs).collect()]
    groups = plain(rows)
    assert len(kept) == len(groups)
    for members in groups.values():
        assert sum(k in members for k in kept) == 1


def test_clashing_columns(spark):
    names = ["_id", "_own", "_key", "dedup", "mixed", "row", "slot", "kept", "bucket", "k", "t", "id", "n"]
    own = {n: f"value of {n}" for n in names}
    texts = [A, A + " more", B, "x y", None, "", C + "\n" + B, B]
    docs = spark.createDataFrame([(i, t, "en", "s" if i % 2 else None, 1, *own.values()) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), name.replace(" ", "-"))
        assert docs.columns == columns, name
        after = docs.collect()
        assert {r.doc_id for r in after} <= before and all(r[n] == own[n] for r in after for n in names), name
        before = {r.doc_id for r in after}
    assert {r.doc_id for r in pipeline.packed(spark, docs, "").collect()} == before and before
