"""The packed sequences follow the mixture."""

import corpus_pipeline as pipeline
from moneytrail.llm.mixing import mix
from moneytrail.llm.packing import pack


def _docs(spark):
    rows = [(i, f"d{i} " + "w " * (50 + 37 * i % 400), "en", "few" if i % 10 == 0 else "many", 5) for i in range(600)]
    rows += [(None, "null id", "en", None, 5), (700, "", "en", "many", 0), (701, None, None, None, None), (3, "again and", "en", "many", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _first_slots(rows, slots):
    first = {}
    for r in rows:
        if r.bin is not None and r[0] in slots:
            first[r.bin] = min(first.get(r.bin, 1 << 60), slots[r[0]])
    return [first[b] for b in sorted(first)]


def test_bins_follow_the_slots(spark):
    docs = _docs(spark).where("doc_id <> 3 AND doc_id < 700")
    slots = {r.doc_id: r.mixed.slot * 4 + r.mixed.place for r in mix(docs).collect()}
    for packed in (lambda: pipeline.packed(spark, docs, ""), lambda: pack(docs, 2048, mixed=True, shard=64)):
        rows = packed().collect()
        assert len(rows) == len(slots) and {r[0] for r in rows} == set(slots)
        firsts = _first_slots(rows, slots)
        assert len(firsts) > 20 and firsts == sorted(firsts)
    # the weights hold from the start: 1 in 10 documents is of the small source, 1 in 4 of the mixture
    few = [slots[r[0]] is not None and r[0] % 10 == 0 for r in sorted(rows, key=lambda r: r.bin)[:128]]
    assert 0.18 < sum(few) / len(few) < 0.32


def test_pieces_are_those_without_the_mixture(spark):
    plain, mixed = (pack(_docs(spark), 100, mixed=m, shard=256).collect() for m in (False, True))
    pieces = lambda rows: sorted(((r.id, r.piece, r.length) for r in rows), key=str)
    assert pieces(plain) == pieces(mixed)
