"""The training-data operators against plain versions, on odd rows and on empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import compare, connect
from moneytrail.llm import queries
from moneytrail.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, kept int, bucket int, n int"
PROSE = "\n".join(" ".join(f"w{i * 7 + j}" for j in range(12)) for i in range(5))


def odd_rows(spark, empty=False):
    texts = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "a text without an id"), (4, " \n\t "), (5, PROSE),
             (6, "long " * 40_000), (7, PROSE + "\nand one line more"), (None, None)]
    rows = [(i, t, None if k % 4 == 3 else "en", None if k % 3 == 2 else "a", 0, "x", 1, 2, 3, 4) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def operators(spark):
    import public_tokenizers
    from moneytrail.llm import fingerprints, line_runs, masked_lm, mixing, near_dedup, packing, quality, suffix_dedup, token_files

    def tokens(docs):
        path = new_path(spark, "tokens")
        token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
        return token_files.token_index(spark, path)

    return {
        "op1": lambda d: packing.pack(d, 60_000), "op2": quality.quality_report, "op4": suffix_dedup.byte_dedup,
        "op5": masked_lm.score_documents, "op6": tokens, "op7": fingerprints.document_fingerprints,
        "op8": line_runs.line_dedup, "op9": near_dedup.near_duplicates, "op10": mixing.mix}


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows_and_empty_tables(spark, name):
    run = operators(spark)[name]
    assert run(odd_rows(spark)).count() == 10
    assert run(odd_rows(spark, empty=True)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, tiny, name):
    verdict, _ = compare(spark, connect(tiny), name, queries.QUERIES[name], queries.ORACLE[name], tiny)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def texts_of(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


def test_best_fit_is_the_tightest_compatible_bin():
    from moneytrail.llm.packing import best_fit
    for seed in range(150):
        r = random.Random(seed)
        size = r.choice([1, 5, 20, 64])
        rows = [(r.randint(1, size), r.randint(0, 3), r.randint(0, r.choice([1, 3, 50]))) for _ in range(r.randint(1, 100))]
        if seed % 2:
            rows.sort(key=lambda x: (-x[0], x[2], x[1]))
        per, bins, want = r.randint(1, 3), [], []
        for n, s, c in rows:
            fit = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and c not in b[2] and b[1].count(s) < per]
            k = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append([size, [], set()])
            want.append(k)
            bins[k][0] -= n
            bins[k][1].append(s)
            bins[k][2].add(c)
        assert best_fit(*map(list, zip(*rows)), size, per)[0] == want


def test_packing_keeps_the_conflicts_apart(spark, tiny):
    rows = queries.QUERIES["op1_best_fit_packing"](spark, tiny).collect()
    assert sum(r.length for r in rows) == sum(len(t.encode().split()) for _, t in texts_of(spark, tiny))
    bins: dict = {}
    for r in rows:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append((r.start, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert all(s + n == t for (s, n), (t, _) in zip(pieces, pieces[1:])) and sum(pieces[-1]) <= 2048


def test_segments_chunks_and_version_lines(spark):
    from moneytrail.llm.warc import read_archives, write_archives
    html = ["x" * 5000, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 300, "", None, "é" * 700, "x" * 5000]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\n", h) for i, h in enumerate(html)] + [(None, None, "x" * 5000)],
                                  "page_id long, url string, html string")
    path = new_path(spark, "warc")
    write_archives(pages, path, segment_bytes=1500, chunk_bytes=100)
    rows = read_archives(spark, path).collect()
    assert len(rows) == 7 and all(r.whole for r in rows)
    got = {r.page_id: r.payload for r in rows if r.type == "response"}
    assert got == {str(i): (html[i] or "").encode() for i in (1, 2, 3, 4, 5)}
    assert {r.page_id for r in rows if r.type == "revisit"} == {"0", None}
    assert read_archives(spark, path).where("type = 'revisit'").select("refers_to").distinct().count() == 1


def test_a_missing_segment_is_noticed():
    import pandas as pd
    from moneytrail.llm.warc import _joined, chunked, dechunked
    part = lambda n, b, t=None: dict(type="response", record_id="r", page_id="1", url=None, refers_to=None, digest=None, segment=n,
                                     total=t, block=b)
    assert _joined(pd.DataFrame([part(2, b"cd", 4), part(1, b"ab")]))[["block", "whole"]].values.tolist() == [[b"abcd", True]]
    assert not _joined(pd.DataFrame([part(3, b"cd", 6), part(1, b"ab")]))["whole"].any()
    assert not _joined(pd.DataFrame([part(2, b"cd", 5), part(1, b"ab")]))["whole"].any()
    assert dechunked(chunked(b"WARC/1.1\r\n" * 9, 7)) == b"WARC/1.1\r\n" * 9 and dechunked(b"5\r\nabc") is None


def test_bytes_in_strings_that_start_earlier(spark, tiny):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op4_suffix_dedup"](spark, tiny).collect()}
    seen = set()
    for doc_id, text in texts_of(spark, tiny):
        data = text.encode()
        out = bytearray(len(data))
        for i in range(len(data) - 99):
            piece = data[i:i + 100]
            if piece in seen:
                out[i:i + 100] = b"\1" * 100
            seen.add(piece)
        runs = sum(1 for i in range(len(out)) if out[i] and not (i and out[i - 1]))
        kept = bytes(b for b, o in zip(data, out) if not o)
        assert got[doc_id] == (len(data), sum(out), runs, hashlib.sha256(kept).hexdigest())


def test_periodic_texts_lose_what_starts_earlier():
    from moneytrail.llm.suffix_dedup import LENGTH, Names
    for text in (b"a" * 400, b"ab" * 200, bytes(range(250)) * 3):
        spans = Names(text).spans(0)
        assert spans["start"][0] == 0 and spans["last"][-1] == len(text) - LENGTH
        assert (spans["start"][1:] == spans["last"][:-1] + 1).all()


def test_the_network_beats_word_frequencies(spark, tiny):
    from moneytrail.llm.masked_lm import bucket_counts, score, train, word_ids
    from moneytrail.llm.common import written
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(2, "doc_id")
    ids = written(word_ids(docs, "doc_id", "text"), "ids")
    fit, held = ids.where("id % 5 <> 0"), ids.where("id % 5 = 0")
    counts = bucket_counts(fit) + 1.0
    share = np.log(counts / counts.sum())
    rows = score(held, train(fit, rounds=2)).collect()
    plain = sum(share[r.ids].sum() for r in held.collect() if r.ids)
    assert sum(r.pll for r in rows) > plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 200), st.integers(0, 2**32 - 1)), max_size=2500))
def test_blocks_round_trip(values):
    from moneytrail.llm.token_files import END, segment, segments
    ids = np.array(values, np.uint32)
    data = segment(3, 0, 7, [5, None], [1, len(ids) - 1] if len(ids) else [0, 0], ids) + END.encode()
    (partition, before, docs, _, back), = segments(data)
    assert (partition, before, docs) == (3, 7, [5, None]) and (back == ids).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'é   \n\t\x1c1.<|>", max_size=30), max_size=4))
def test_stretches_encode_as_whole_texts(texts):
    import public_tokenizers
    from moneytrail.llm.token_files import _encoder
    texts = [*texts, "x <|endoftext|> y<|endoftext|>z"]
    encoder = _encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want


def test_token_files_hold_the_ids(spark, tiny):
    import public_tokenizers
    from tokenizers import Tokenizer
    rows = queries.QUERIES["op6_token_files"](spark, tiny).orderBy("doc_id").collect()
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r, (doc_id, text) in zip(rows, texts_of(spark, tiny), strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_fingerprints_of_edits_and_neighbours(spark, tiny):
    from moneytrail.llm.fingerprints import edited, fingerprint, likeness, neighbours
    texts = texts_of(spark, tiny)
    rows = {r.doc_id: r for r in queries.QUERIES["op7_fingerprints"](spark, tiny).collect()}
    for (doc_id, text), (_, following) in zip(texts, [texts[-1], *texts]):
        own, new = fingerprint(text.encode()), edited(text, following)
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex())
        assert r.near_edited == likeness(own, fingerprint(new.encode())) and r.near_next == likeness(own, fingerprint(following.encode()))
    rng = np.random.default_rng(1)
    base = [rng.bytes(16) for _ in range(30)]
    flip = lambda x, k: (int.from_bytes(x) ^ sum(1 << int(b) for b in rng.choice(128, k, replace=False))).to_bytes(16)
    prints = list({*base, *(flip(b, k) for b in base for k in (1, 2, 3, 4))})
    near = lambda a: sum((int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= 3 for b in prints) - 1
    got = {bytes(r.fp): r.n_near for r in neighbours(spark.createDataFrame([(bytearray(p),) for p in prints], "fp binary")).collect()}
    assert got == {p: n for p in prints if (n := near(p))}


def test_components_of_fingerprints(spark, tiny):
    import xxhash
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op9_simhash_near_dedup"](spark, tiny).collect()}
    texts, prints = texts_of(spark, tiny), []
    for _, text in texts:
        w = text.encode().lower().split()
        votes, pieces = [0] * 64, [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        for p in pieces:
            h = xxhash.xxh64_intdigest(p, 42)
            votes = [v + (h >> b & 1) for b, v in enumerate(votes)]
        prints.append(sum(1 << b for b, v in enumerate(votes) if 2 * v > len(pieces)))
    root = list(range(len(prints)))
    for _ in root:
        new = [min([root[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2]) for i in range(len(prints))]
        if new == root:
            break
        root = new
    assert got == {d: (f"{p:016x}", texts[r][0]) for (d, _), p, r in zip(texts, prints, root)}


def test_pfair_deviates_by_less_than_a_block():
    from moneytrail.llm.mixing import edf_cycle, flattened
    for seed in range(30):
        r = random.Random(seed)
        shares = {f"s{i}": r.randint(1, 40) for i in range(r.randint(1, 12))} | ({None: 3} if seed % 3 else {})
        total, given_ = sum(shares.values()), dict.fromkeys(shares, 0)
        for source, j, slot, release, due in edf_cycle(shares):
            assert j == given_[source] and release <= slot < due
            given_[source] += 1
            assert all(abs(given_[s] * total - shares[s] * (slot + 1)) < total for s in shares)
        assert given_ == shares
    assert flattened({"a": 100, "b": 1}) == {"a": 100, "b": 10}
