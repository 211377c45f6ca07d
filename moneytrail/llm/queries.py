"""The operators over the synthetic tables, one registered query each, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from moneytrail.llm.near_dedup import near_duplicates
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document."""
    from moneytrail.llm.quality import quality_report
    return quality_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE["op2_quality_rules"] = r"""
WITH split_up AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM split_up, unnest(range(1, len(w) - 3)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS n FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM again) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
      - len(list_distinct([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM split_up s LEFT JOIN covered c ON c.doc_id = s.doc_id),
rates AS (SELECT *, greatest(n_words, 1) AS d FROM measured),
long AS (
  SELECT doc_id, lang, source, 'word_length' AS metric, word_chars * 1000 // d AS v FROM rates WHERE n_words > 0
  UNION ALL SELECT doc_id, lang, source, 'symbols', n_symbols * 1000 // d FROM rates WHERE n_words > 0
  UNION ALL SELECT doc_id, lang, source, 'dup_lines', n_dup_lines * 1000 // d FROM rates WHERE n_words > 0
  UNION ALL SELECT doc_id, lang, source, 'repeats', n_repeat_words * 1000 // d FROM rates WHERE n_words > 0),
sketch AS (
  SELECT lang, source, metric, (v >> s) << s AS bucket, count(*) AS n FROM
    (SELECT *, CAST(greatest(0, length(bin(v)) - 7) AS BIGINT) AS s FROM long) GROUP BY ALL),
levels AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM sketch GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM sketch GROUP BY metric, bucket),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total,
    sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS up_to FROM levels),
cuts AS (
  SELECT level, lang, source, metric, max(total) AS total, min(bucket) FILTER (4 * up_to >= total) AS q1,
    min(bucket) FILTER (4 * up_to >= 3 * total) AS q3 FROM ranked GROUP BY level, lang, source, metric),
rules AS (SELECT * FROM (VALUES ('word_length', 500, 4, true), ('symbols', 100, 3, false), ('dup_lines', 50, 3, false),
  ('repeats', 100, 3, false)) AS r(metric, least_spread, reach, has_low)),
limited AS (
  SELECT c.*, q3 + reach * greatest(q3 - q1, least_spread) AS high,
    CASE WHEN has_low THEN q1 - reach * greatest(q3 - q1, least_spread) END AS low FROM cuts c JOIN rules USING (metric)),
outside AS (
  SELECT l.doc_id, bool_or(
      l.v > CASE WHEN a.total >= 200 THEN a.high WHEN b.total >= 200 THEN b.high ELSE c.high END
      OR coalesce(l.v < CASE WHEN a.total >= 200 THEN a.low WHEN b.total >= 200 THEN b.low ELSE c.low END, false)) AS bad
  FROM long l
  JOIN limited a ON a.level = 0 AND a.metric = l.metric AND a.lang IS NOT DISTINCT FROM l.lang AND a.source IS NOT DISTINCT FROM l.source
  JOIN limited b ON b.level = 1 AND b.metric = l.metric AND b.lang IS NOT DISTINCT FROM l.lang
  JOIN limited c ON c.level = 2 AND c.metric = l.metric GROUP BY l.doc_id),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM based m LEFT JOIN outside o ON o.doc_id = m.doc_id"""


@query
def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC archives, reads them back and says what was found."""
    from moneytrail.llm.common import new_path, written
    from moneytrail.llm.warc import read_archives, resolved, write_archives
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path, segment_bytes=16_384)
    found = read_archives(spark, path).where("whole").select(
        "type", "record_id", F.col("page_id").cast("long").alias("page_id"), "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    return resolved(written(found, "records"))


ORACLE["op3_warc_archives"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
  sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k"""


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token ids of all documents, reads the files back and says where each document is."""
    import public_tokenizers
    from moneytrail.llm.common import new_path
    from moneytrail.llm.token_files import token_index, write_tokens
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path)


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how many other fingerprints are within three bits."""
    from moneytrail.llm.common import written
    from moneytrail.llm.fingerprints import document_fingerprints, neighbours
    rows = written(document_fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    near = neighbours(rows.select(F.col("fingerprint").alias("fp")))
    return rows.join(near, rows["fingerprint"] == near["fp"], "left").select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.coalesce("n_near", F.lit(0)).alias("n_near"))


@query
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of repeated runs of lines."""
    from moneytrail.llm.line_runs import line_dedup
    rows = line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("dedup.n_lines").cast("long").alias("n_lines"),
                       F.col("dedup.n_deleted").cast("long").alias("n_deleted"),
                       F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op8_line_runs"] = r"""
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
l AS (
  SELECT doc_id, n, line, trim(line) AS key, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos,
    len([x for x in regexp_split_to_array(line, '[\x20\x09-\x0D]+') if x <> '']) AS w
  FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS up_to FROM l),
spans AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 7
  WHERE b.up_to - a.up_to + a.w >= 8 GROUP BY a.doc_id, a.pos
  UNION SELECT a.doc_id, max(b.pos), a.pos FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 7 AND a.pos
  WHERE a.up_to - b.up_to + b.w >= 8 GROUP BY a.doc_id, a.pos),
runs AS (SELECT s.doc_id, s, e, string_agg(key, chr(10) ORDER BY pos) AS run FROM spans s JOIN l ON l.doc_id = s.doc_id AND pos BETWEEN s AND e
  GROUP BY s.doc_id, s, e),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM later),
marked AS (SELECT y.doc_id, y.n, y.line, g.pos IS NOT NULL AS out, l.pos IS NOT NULL AS full_line FROM every y
  LEFT JOIN l ON l.doc_id = y.doc_id AND l.n = y.n LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos),
kept AS (SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (out) AS n_deleted,
  coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT out), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_deleted, CAST(length(t) AS BIGINT) AS kept_chars, sha256(t) AS kept_sha256 FROM kept"""


@query
def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mixture of all sources with flattened weights."""
    from moneytrail.llm.mixing import mix
    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("doc_id", "source", "mixed.block", F.col("mixed.place").cast("long").alias("place"), "mixed.slot",
                       "mixed.release", "mixed.deadline")


ORACLE["op10_pfair_mixing"] = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
shares AS (SELECT source, row_number() OVER (ORDER BY source) AS i,
  greatest(1, CAST(ceil(100 * sqrt(c / (SELECT max(c) FROM counts))) AS BIGINT)) AS n FROM counts),
setting AS (SELECT list(n ORDER BY i) AS n, CAST(sum(n) AS BIGINT) AS total, count(*) AS sources FROM shares),
edf(slot, k, pick) AS (
  SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) for x in range(sources)], CAST(0 AS BIGINT) FROM setting
  UNION ALL
  SELECT slot, [k[x] + CASE WHEN x = pick THEN 1 ELSE 0 END for x in range(1, sources + 1)], pick FROM (
    SELECT slot + 1 AS slot, k, sources, list_min([((k[x] + 1) * total + n[x] - 1) // n[x] * 100000 + x
      for x in range(1, sources + 1) if k[x] < n[x] AND k[x] * total // n[x] <= slot + 1]) % 100000 AS pick
    FROM edf, setting WHERE slot + 1 < total)),
cycle AS (SELECT s.source, s.n, k[s.i] - 1 AS j, slot, total FROM edf, setting, shares s WHERE s.i = edf.pick),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS r FROM documents),
blocks AS (SELECT r.doc_id, r.source, r // 4 AS block, r % 4 AS place, s.n FROM ranked r JOIN shares s ON s.source = r.source)
SELECT b.doc_id, b.source, b.block, b.place, b.block // b.n * total + slot AS slot,
  b.block // b.n * total + j * total // b.n AS release,
  b.block // b.n * total + ((j + 1) * total + b.n - 1) // b.n AS deadline
FROM blocks b JOIN cycle c ON c.source = b.source AND c.j = b.block % b.n"""


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document, in sequences of 2048 words."""
    from moneytrail.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), capacity=2048).withColumnRenamed("id", "doc_id")


@query
def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document."""
    from moneytrail.llm.masked_lm import score_documents
    return score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 100-byte strings that start earlier."""
    from moneytrail.llm.suffix_dedup import byte_dedup
    return byte_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of every order, per source, and its exact share."""
    from moneytrail.llm.filter_audit import audit, failures
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE["op11_filter_audit"] = r"""
WITH split_up AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
failing AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) ||
    (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END) ||
    (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END) ||
    (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) ||
    (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM split_up),
marked AS (
  SELECT f.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM failing f LEFT JOIN
    (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = f.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM marked GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
first_hit AS (SELECT part, fails, n, g, x, o, coalesce(list_min([instr(o, c) for c in string_split(fails, '') if c <> '']), 6) AS hit
  FROM cells, orders),
steps AS (SELECT o, CAST(k AS INTEGER) AS step, substr(o, CAST(k AS INTEGER), 1) AS f FROM orders, range(1, 6) AS r(k)),
counted AS (
  SELECT h.part, h.o AS filter_order, s.step, any_value(s.f) AS f, CAST(coalesce(sum(n) FILTER (hit > s.step), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (hit = s.step), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (contains(fails, s.f) AND hit < s.step), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = s.f), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(g) FILTER (hit = s.step), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(x) FILTER (hit = s.step), 0) AS BIGINT) AS toxic_lost
  FROM first_hit h JOIN steps s ON s.o = h.o GROUP BY h.part, h.o, s.step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted"""


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language."""
    from moneytrail.llm.phrases import collocations
    return collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_phrases"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(p, '[\x20\x09]+') if x <> ''] AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM w, unnest(range(1, 6)) AS s(m), unnest(range(1, len(w) - m + 2)) AS u(i)),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g HAVING count(*) >= 100),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, t.n,
    (1000::HUGEINT * a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM c, unnest(range(1, m)) AS s(k) JOIN totals t ON t.lang = c.lang JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS g, max(a) AS a
  FROM c, unnest(range(2, m)) AS s(j), unnest(range(1, m - j + 2)) AS u(i) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.g)) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.a IS NULL OR 100 * i.a < 100 * b.a)
SELECT lang, rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document in 24 shards of nearly equal bytes, equal texts together."""
    from moneytrail.llm.sharding import shard_index
    return shard_index(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
