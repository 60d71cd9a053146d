"""Queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.bpe import decode_bpe, encode_bpe
from ridgeline.llm.conversation import damaged, repair, summaries
from ridgeline.llm.divergence import MIN_DOCS, SCALE, SMOOTH, TOP, audit_sources
from ridgeline.llm.html_text import main_text
from ridgeline.llm.huffman import file_starts, read_ids, store_tokens
from ridgeline.llm.language import identify, page_evidence
from ridgeline.llm.line_dedup import LINE, MIN_WORDS, dedup_lines
from ridgeline.llm.mih import BITS, K, sign_code, top_k
from ridgeline.llm.mixing import mix
from ridgeline.llm.ngram_join import similar_components
from ridgeline.llm.ogg import decode_ogg, encode_ogg
from ridgeline.llm.quality import score_quality
from ridgeline.llm.sharding import shard_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows by the signs of their embeddings, for every row whose id is divisible by 50."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes, codes.where("id % 50 = 0"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are alike by 0.85 or more."""
    return similar_components(table(spark, sf_dir, "documents"), n=4, p=85, q=100)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the runs of lines that occurred before."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines", "removed_words")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document go into the mix."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_mix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every document belongs to two sources, its own and its language's: quotas share documents, so words are routed."""
    docs = table(spark, sf_dir, "documents").withColumn("sources", F.array(F.concat(F.lit("at "), "source"), F.concat(F.lit("in "), "lang")))
    mixed = mix(docs, sources_col="sources")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; ``lang`` is what it declares and ``source`` its host."""
    return identify(table(spark, sf_dir, "documents"))


def op6_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, by its text, its markup and its address."""
    return identify(page_evidence(table(spark, sf_dir, "pages")), id_col="page_id", host_col="host")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard; equal texts are kept together where quotas allow."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; the ids' and the decoded bytes' digests."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = decode_bpe(encode_bpe(docs, path, pattern, space_begins=True), path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written in ascending order of doc_id, read back from the files, with their place in the stream."""
    docs = table(spark, sf_dir, "documents")
    files = store_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), n_ids=49_408, end_id=2)
    rows = read_ids(files, docs.schema["doc_id"].dataType.simpleString())
    rows = rows.select("id", "part", "seq", "local", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    placed = rows.join(file_starts(files), ["part", "seq"])
    return placed.select(F.col("id").alias("doc_id"), (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg medium, read back: digests of the medium and its payload, and features."""
    media = decode_ogg(encode_ogg(table(spark, sf_dir, "documents")))
    return media.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule: its faults, the cheapest repair and the digest of what it gives."""
    rows = table(spark, sf_dir, "conversations")
    found, all_of = summaries(repair(damaged(rows))), rows.select("conv_id").distinct()
    count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    text = F.coalesce("repaired", F.lit(""))
    joined = all_of.join(found, all_of["conv_id"].eqNullSafe(found["conv"]), "left")
    return joined.select("conv_id", *count, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and each source's own terms."""
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op4_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_quality that SQL can state: which documents no label is learnt from."""
    return op4_quality(spark, sf_dir).select("doc_id", "held_out")


def op5_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_mix that SQL can state: sizes and targets."""
    return op5_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def op7_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_shards that SQL can state: rows of each shard, their slots and all sizes."""
    shards = op7_shards(spark, sf_dir).groupBy("shard")
    counts = shards.agg(F.count("*").alias("rows"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("size"))
    return counts.select("shard", "rows", "slots", "last", F.sum("size").over(Window.partitionBy()).alias("size"))


def op8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_byte_bpe that SQL can state: the decoded bytes are the text's."""
    return op8_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def op10_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_ogg that SQL can state: the payload that is read back."""
    return op10_ogg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_mix": op5_mix,
    "op5_mix_overlap": op5_mix_overlap,
    "op6_language": op6_language,
    "op6_language_pages": op6_language_pages,
    "op7_shards": op7_shards,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_huffman_ids": op9_huffman_ids,
    "op10_ogg": op10_ogg,
    "op11_repair": op11_repair,
    "op12_divergence": op12_divergence,
    "op13_html": op13_html,
    "op4_folds": op4_folds,
    "op5_targets": op5_targets,
    "op7_quotas": op7_quotas,
    "op8_decoded": op8_decoded,
    "op10_payload": op10_payload,
}

WORD = r"[^\x20\x09-\x0D]+"
#: One step of the checksum.
_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"

OP1_SQL = f"""
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0 AND NOT isnan(x)) AS signs FROM embeddings WHERE len(embedding) = {BITS}),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id,
         CAST(len(list_filter(list_zip(q.signs, r.signs), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
  FROM codes q, codes r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM pairs) WHERE k <= {K}
"""

OP3_SQL = rf"""
WITH docs AS (SELECT doc_id, text FROM documents),
raw AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '{LINE}') AS parts FROM docs)),
lines AS (
  SELECT doc_id, pos, regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
         CAST(len(regexp_extract_all(part, '{WORD}')) AS BIGINT) AS n
  FROM raw WHERE len(regexp_extract_all(part, '{WORD}')) > 0),
ext AS (
  SELECT *, CAST(e - n AS BIGINT) AS s
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e FROM lines)),
windows AS (
  SELECT DISTINCT doc_id, c, f, t FROM (
    SELECT doc_id, string_agg(line, chr(10)) OVER w AS c, min(s) OVER w AS f, max(e) OVER w AS t FROM ext
    WINDOW w AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
    UNION ALL
    SELECT doc_id, string_agg(line, chr(10)) OVER w, min(s) OVER w, max(e) OVER w FROM ext
    WINDOW w AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW))
  WHERE t - f >= {MIN_WORDS}),
repeats AS (
  SELECT doc_id, f, t
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, f) AS k FROM windows) WHERE k > 1),
gone AS (
  SELECT *, EXISTS (SELECT 1 FROM repeats r WHERE r.doc_id = x.doc_id AND r.f <= x.s AND r.t > x.s) AS gone FROM ext x),
runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b, count(*) AS n_lines, sum(n) AS n_words
  FROM (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM gone)
  WHERE gone GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, string_agg(part, '' ORDER BY pos) AS text FROM raw x
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.pos BETWEEN r.a AND r.b) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(n_lines) AS n_lines, sum(n_words) AS n_words FROM runs GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(s.n_lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(s.n_words, 0) AS BIGINT) AS removed_words
FROM docs d LEFT JOIN sums s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS x, a AS y FROM edges UNION SELECT r.x, e.b FROM reach r JOIN edges e ON e.a = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM sets s LEFT JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = s.doc_id
"""

OP4_FOLDS_SQL = f"""
WITH d AS (SELECT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda t: CAST(ascii(t) AS BIGINT)) AS t FROM documents)
SELECT doc_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], t), lambda c, b: {_STEP}), 4294967295) % 3 = 1 AS held_out FROM d
"""

OP5_TARGETS_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3e0 * z / w, source) AS k FROM r),
c AS (SELECT k.k, (SELECT sum(z) FROM o) - coalesce(sum(3 * i.z), 0) AS rest FROM (SELECT unnest(range(0, (SELECT count(*) FROM o))) AS k) k LEFT JOIN o i ON i.k <= k.k GROUP BY k.k),
l AS (SELECT c.k, c.rest / (SELECT sum(w) FROM o WHERE o.k > c.k) AS per FROM c),
b AS (SELECT min(l.k) AS k, arg_min(l.per, l.k) AS per FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k > l.k AND l.per * o.w > 3e0 * o.z)),
t AS (SELECT o.source, o.z, CASE WHEN o.k <= b.k THEN 3e0 * o.z ELSE b.per * o.w END AS target FROM o, b)
SELECT d.doc_id, d.size, t.z AS source_size, round(t.target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

OP7_QUOTAS_SQL = """
WITH d AS (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 8) AS BIGINT) AS size FROM documents),
s AS (SELECT unnest(range(0, 24)) AS shard), q AS (SELECT s.shard, d.n // 24 + CASE WHEN s.shard < d.n % 24 THEN 1 ELSE 0 END AS rows, size FROM s, d)
SELECT CAST(shard AS INTEGER) AS shard, rows, rows AS slots, rows - 1 AS last, size FROM q WHERE rows > 0
"""

OP8_DECODED_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

OP10_PAYLOAD_SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, CAST(octet_length(b) AS BIGINT) AS n, CAST(greatest(1, (octet_length(b) + 575) // 576) * 576 AS BIGINT) AS m FROM t)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || repeat('\xFF'::BLOB, m - n)) AS payload_sha256 FROM p
"""

OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * v) AS p FROM cell JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang) + {SMOOTH} * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT lang, source, part, item, coalesce(value, 0) AS value FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""

#: Repair with whole strings as states, one row of every conversation at a time.
OP11_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda t: CAST(ascii(t) AS BIGINT))),
    lambda c, b: {_STEP}), 4294967295) % 20 AS kind FROM conversations),
h AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said, left(role, 1) AS i FROM h),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM o),
ways(f, mid, ins) AS (VALUES ('', '', ''), ('', 'u', 'u'), ('', 'a', 'ua'), ('s', 's', ''), ('s', 'u', 'u'), ('s', 'a', 'ua'), ('u', 'u', ''), ('u', 'a', 'a'), ('u', 'u', 'au'), ('a', 'a', ''), ('a', 'u', 'u'), ('a', 'a', 'ua')),
moves(mid, letter, t) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
edits(edit) AS (VALUES ('D'), ('K'), ('R')),
st AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '' AS s, {{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}} AS b FROM f
  UNION ALL
  SELECT conv_id, pos, s, arg_min(b, {{'c': b.c, 'a': b.a}}) AS b FROM (
    SELECT f.conv_id, f.pos, CASE WHEN edit = 'D' THEN w.mid ELSE m.t END AS s, {{
      'c': st.b.c + 2 * length(w.ins) + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
      'a': st.b.a || repeat('I', length(w.ins)) || edit,
      'l': list_concat(st.b.l, list_concat(list_transform(range(1, length(w.ins) + 1), lambda x: CASE substring(w.ins, x, 1) WHEN 'u' THEN 'user:' ELSE 'assistant:' END),
        CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE m.letter WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END))}} AS b
    FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.pos = st.pos + 1 JOIN ways w ON w.f = st.s JOIN edits ON true
    LEFT JOIN moves m ON m.mid = w.mid AND (edit = 'K' AND m.letter = f.i OR edit = 'R' AND m.letter IN ('u', 'a'))
    WHERE edit = 'D' OR (m.t IS NOT NULL AND fault NOT IN ('blank', 'duplicate'))) x
  GROUP BY conv_id, pos, s),
n AS (SELECT conv_id, count(*) AS rows, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT st.conv_id, arg_min({{'c': b.c + t.c, 'a': b.a || repeat('I', t.c // 2), 'l': list_concat(b.l, t.l)}}, {{'c': b.c + t.c, 'a': b.a || repeat('I', t.c // 2)}}) AS b
  FROM st JOIN n ON n.conv_id IS NOT DISTINCT FROM st.conv_id AND n.rows = st.pos
  JOIN (VALUES ('', 0, CAST([] AS VARCHAR[])), ('a', 0, []), ('u', 2, ['assistant:']), ('s', 4, ['user:', 'assistant:'])) t(s, c, l) ON t.s = st.s GROUP BY st.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.b.c, 0) AS BIGINT) AS cost,
  coalesce(e.b.a, '') AS audit, sha256(coalesce(array_to_string(e.b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: The pages' own markup: headings and paragraphs of the article that is their main text.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS a FROM pages),
b AS (SELECT page_id, list_transform(regexp_split_to_array(regexp_replace(a, '</?[a-z0-9]*$', ''), '</?(p|h[1-6])>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS b FROM a),
c AS (SELECT page_id, list_transform(b, lambda x: trim(regexp_replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&quot;', '"'), '&copy;', '©'), '\s+', ' ', 'g'))) AS c FROM b),
t AS (SELECT page_id, array_to_string(list_filter(c, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT a.page_id, a.url, t.text, CAST(length(t.text) AS BIGINT) AS n_chars FROM a JOIN t ON a.page_id = t.page_id
"""

ORACLES: dict[str, str] = {
    "op11_repair": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_html": OP13_SQL,
    "op1_hamming_topk": OP1_SQL,
    "op2_ngram_join": OP2_SQL,
    "op4_folds": OP4_FOLDS_SQL,
    "op5_targets": OP5_TARGETS_SQL,
    "op7_quotas": OP7_QUOTAS_SQL,
    "op8_decoded": OP8_DECODED_SQL,
    "op10_payload": OP10_PAYLOAD_SQL,
    "op3_line_dedup": OP3_SQL,
}
