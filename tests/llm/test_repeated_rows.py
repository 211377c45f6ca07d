"""Rows that stand in a table several times are one place: none is a later copy of the other."""

from pyspark.sql import functions as F

from moneytrail.llm.line_runs import line_dedup
from moneytrail.llm.suffix_dedup import byte_dedup

LONG = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(90))


def test_bytes_of_repeated_rows(spark):
    rows = [(1, LONG), (1, LONG), (2, OTHER), (2, LONG + OTHER[:150]), (3, LONG), (4, OTHER), (4, OTHER), (5, "new " + OTHER), (None, LONG)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5, F.rand(1))
    places = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.col("text").cast("binary")), "text").distinct().collect()
    want, seen = {}, set()
    for doc_id, _, text in sorted(places):
        data = text.encode()
        out = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                out[i:i + 100] = b"\1" * 100
            seen.add(data[i:i + 100])
        want[doc_id, text] = bytes(b for b, o in zip(data, out) if not o)
    assert want[1, LONG] == LONG.encode() and want[3, LONG] == b""
    got = byte_dedup(docs).collect()
    assert len(got) == 2 * len(rows)
    kept = sorted((r.id, bytes(r.kept)) for r in got if r.id is not None)
    assert kept == sorted((i, want[i, t]) for i, t in rows * 2 if i is not None)
    assert [bytes(r.kept) for r in got if r.id is None] == [LONG.encode()] * 2


def test_short_lines_of_repeated_rows(spark):
    shared, own = "red fox ran home\nblue hen sat down", "one more line here"
    docs = spark.createDataFrame([(1, shared), (2, shared + "\n" + own), (2, shared + "\n" + own), (3, own), (3, own)],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup(docs).collect())
    assert got == [(1, shared), (2, own), (2, own), (3, own), (3, own)]
