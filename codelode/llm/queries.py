"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.catalogue import Catalogue
from codelode.llm.common import table

LLM = Catalogue()

#: Rendezvous sharding in SQL; crc32 is folded over the bytes with its 256-entry table, made from the polynomial.
SHARDS = 16


def _shard_sql(shards: int) -> str:
    return (
        f"list_aggregate(list_transform(range({shards}), lambda s: {{'score': -ln((('0x' || substr(md5(name || '#' || s), 1, 13))::BIGINT"
        " + 0.5) / 4503599627370496.0), 'shard': s}), 'min').shard"
    )


OP3_SQL = f"""
WITH t0 AS (SELECT i AS n, i::BIGINT AS c FROM range(256) r(i)),
t1 AS (SELECT n, list_reduce(list_prepend(c, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM t0),
crc AS (SELECT list(c ORDER BY n) AS cells FROM t1),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS name, hex(encode(coalesce(text, ''))) AS hexed, row_number() OVER () AS r FROM documents),
b AS (SELECT r, list_transform(regexp_extract_all(hexed, '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM d),
e AS (
  SELECT doc_id, name, length(hexed) // 2 + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, cells[(xor(a, x) & 255) + 1]))) AS text_crc32
  FROM d JOIN b USING (r), crc),
s AS (
  SELECT doc_id, size, text_crc32, {_shard_sql(SHARDS)} AS shard, {_shard_sql(SHARDS + 1)} AS grown_shard,
    ('0x' || substr(md5(name || '/' || text_crc32), 1, 8))::BIGINT % 4096 AS slice
  FROM e)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, size, text_crc32) - 1 AS slot
FROM s
"""


@LLM.query("op3_rendezvous_shards", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.sharding import assign_shards

    placed = assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.withColumn("law", F.lit("key"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
k AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.*, o.owner IS NULL OR o.owner = doc_id AS stays FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE stays), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


@LLM.query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.line_dedup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@LLM.query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codelode.llm.common import saved
    from codelode.llm.packing import pack, token_pieces

    pieces = token_pieces(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.path("byte_bpe_50k.json"),
    )
    return pack(saved(pieces, "token-pieces"))


@LLM.query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.quality import is_held_out, quality_score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return quality_score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def similar_sql(documents: str, size: int, percent: int) -> str:
    """doc_id, n_shingles, component_id of all documents by counting the shingles that each two share."""
    shingle = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(size))
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {documents}),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: {shingle}) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM {documents} UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.root)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


@LLM.query("op5_ngram_jaccard", similar_sql("documents", 3, 90))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fractions import Fraction

    from codelode.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=Fraction(9, 10))


#: Eleven of thirteen tokens (in proportion for shorter items) agree, so four in a row do: found by exact runs of four.
#: Items under eight tokens are compared as a whole.
_TOKENS_SQL = (
    r"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '([\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{3134F}])', ' \1 ', 'g')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
)
LEAKS_SQL = rf"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, {_TOKENS_SQL} AS ws FROM {{documents}}
  UNION ALL
  SELECT DISTINCT 'b', item_id, {_TOKENS_SQL} FROM benchmark),
g AS (SELECT kind, id, ws, unnest(range(1, len(ws) - 2)) AS i FROM t),
h AS (SELECT kind, id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] AS run FROM g),
m AS (SELECT DISTINCT a.id AS doc_id, b.id AS item_id, a.i - b.i AS shift FROM h a JOIN h b ON a.run = b.run WHERE a.kind = 'd' AND b.kind = 'b'),
p AS (
  SELECT doc_id, item_id, shift, least(13, len(b.ws)) AS w,
    list_transform(range(greatest(1, 1 + shift), least(len(d.ws), len(b.ws) + shift) + 1), lambda i: (d.ws[i] = b.ws[i - shift])::INTEGER) AS hits
  FROM m JOIN t d ON d.kind = 'd' AND d.id = doc_id JOIN t b ON b.kind = 'b' AND b.id = item_id WHERE len(b.ws) >= 8),
q AS (SELECT doc_id, item_id, shift, w, list_max(list_transform(range(1, len(hits) - w + 2), lambda i: list_sum(hits[i:i + w - 1]))) AS matched FROM p),
s AS (SELECT d.id AS doc_id, b.id AS item_id, d.ws AS dw, b.ws AS bw, unnest(range(1, len(d.ws) - len(b.ws) + 2)) AS i FROM t d JOIN t b ON d.kind = 'd' AND b.kind = 'b' AND len(b.ws) BETWEEN 1 AND 7)
SELECT doc_id, item_id, count(*) AS alignments, max(matched)::BIGINT AS matched FROM q WHERE matched >= w - floor(w * 2 / 13) GROUP BY doc_id, item_id
UNION ALL
SELECT doc_id, item_id, count(*), max(len(bw))::BIGINT FROM s WHERE dw[i:i + len(bw) - 1] = bw GROUP BY doc_id, item_id
"""


@LLM.query("op4_decontamination", LEAKS_SQL.replace("{documents}", "documents"))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All pairs of vectors; the sorted passes have to find the same links.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.root),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


@LLM.query("op10_embedding_near_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@LLM.query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codelode.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _license_sql() -> str:
    from codelode.llm.license_scan import KNOWN, LEAD, LONGEST, MOST_WORDS, RULES, STARTS

    known = ", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())
    starts = ", ".join(f"'{s}'" for s in STARTS)
    orders = [(n, "".join(f"<{x}>" for x in ids), licence) for n, (ids, licence) in enumerate(RULES) if len(ids) > 1]
    single = ", ".join(f"('{ids[0]}', {n}, '{licence}')" for n, (ids, licence) in enumerate(RULES) if len(ids) == 1)
    steps = [f"s{k + 1} AS MATERIALIZED (SELECT r, doc_id, replace(told, '{told}', '<>') AS told FROM s{k})" for k, (_, told, _) in enumerate(orders)]
    hits = [
        f"SELECT doc_id, {n} AS rule, '{licence}' AS licence, ((length(told) - length(replace(told, '{told}', ''))) // {len(told)})::INTEGER AS statements"
        f" FROM s{k} WHERE contains(told, '{told}')"
        for k, (n, told, licence) in enumerate(orders)
    ]
    return rf"""
WITH known(form, id) AS (VALUES {known}),
single(id, rule, licence) AS (VALUES {single}),
w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(regexp_replace(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'),
      '\n[ \t\r]*([A-Z\n])', chr(1) || '\1', 'g'), '\x01|[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*') AS words
  FROM documents WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT r, doc_id, list_filter(list_transform(string_split(replace(lower(array_to_string(words, ' ')), 'licence', 'license'), chr(1)),
      lambda x: trim(x)), lambda x: x <> '') AS parts FROM w),
u AS MATERIALIZED (SELECT r, doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS n FROM d),
b AS (SELECT r, n FROM u WHERE array_to_string(string_split(piece, ' ')[1:2], ' ') IN ({starts})),
l AS (SELECT b.r, b.n, k.k, array_to_string(d.parts[b.n : b.n + k.k - 1], ' ') AS joined FROM b JOIN d USING (r), range(1, {MOST_WORDS} + 1) k(k)
  WHERE b.n + k.k - 1 <= len(d.parts)),
h AS (SELECT l.r, l.n, max(k) AS k, arg_max(id, k) AS id FROM l JOIN known ON form = regexp_replace(joined, '{LEAD}', 'under ')
  WHERE length(joined) <= {LONGEST} GROUP BY ALL),
m AS (SELECT u.r, doc_id, u.n, coalesce(h.id, CASE WHEN piece LIKE '%licens%' OR piece LIKE '%licenc%' OR piece LIKE '%copyright%' THEN 'Unknown' END) AS id,
    coalesce(max(u.n + h.k) OVER (PARTITION BY u.r ORDER BY u.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > u.n, false) AS within_another
  FROM u LEFT JOIN h ON h.r = u.r AND h.n = u.n),
s0 AS MATERIALIZED (SELECT r, doc_id, string_agg('<' || id || '>', '' ORDER BY n) AS told FROM m WHERE id IS NOT NULL AND NOT within_another GROUP BY r, doc_id),
{", ".join(steps)},
z AS (SELECT r, doc_id, unnest(regexp_extract_all(told, '<([^>]+)>', 1)) AS id FROM s{len(orders)})
{" UNION ALL ".join(hits)}
UNION ALL SELECT doc_id, rule, licence, count(*)::INTEGER FROM z JOIN single USING (id) GROUP BY r, doc_id, rule, licence
"""


@LLM.query("op2_license_scan", _license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.license_scan import license_statements

    return license_statements(table(spark, sf_dir, "documents"))


_SITE_SQL = r"""
  regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^(www|m)\.|:(80|443)$', '', 'g')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(/index)?(\.html?)?/*$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""

OP7_SQL = rf"""
WITH p AS (SELECT *, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (page_id // 1440) AS day, sha256(html) AS digest FROM pages),
c AS (
  SELECT page_id * 2 AS record_id, page_id * 60 AS ts, url, 'response' AS kind, tag AS etag, day AS lm, digest FROM p
  UNION ALL
  SELECT page_id * 2 + 1, CASE WHEN page_id % 13 = 0 THEN page_id * 60 - 30 ELSE page_id * 60 + 60 * (page_id % 200) + 30 END,
    regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=again#top', 'revisit',
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || tag END, CASE WHEN page_id % 22 = 0 THEN NULL ELSE day END, digest
  FROM p WHERE page_id % 3 <> 2),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z]+://', '') AS bare FROM c),
k AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref)(=|$)'))) AS kept FROM b),
s AS (SELECT *, {_SITE_SQL} AS site FROM k),
f AS (SELECT site, ts, max(record_id) AS response_id FROM s WHERE kind = 'response' GROUP BY site, ts),
m AS (SELECT v.*, f.response_id FROM (SELECT * FROM s WHERE kind = 'revisit') v ASOF LEFT JOIN f ON v.site = f.site AND v.ts > f.ts),
j AS (
  SELECT m.record_id, m.response_id, m.ts, m.etag, m.lm, r.etag AS old_etag, r.lm AS old_lm, r.digest AS old_digest,
    CASE WHEN m.response_id IS NULL THEN 'missing'
      WHEN m.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN regexp_replace(m.etag, '^W/', '') = r.etag THEN 'resolved' ELSE 'mismatch' END
      WHEN m.lm IS NOT NULL AND r.lm IS NOT NULL THEN CASE WHEN m.lm = r.lm THEN 'resolved' ELSE 'mismatch' END
      WHEN m.digest = r.digest THEN 'resolved' ELSE 'mismatch' END AS state
  FROM m LEFT JOIN s r ON r.record_id = m.response_id)
SELECT record_id, response_id, state,
  CASE WHEN state = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
    || 'etag: ' || coalesce(etag, old_etag) || chr(10) || 'last-modified: ' || coalesce(lm, old_lm) END AS headers,
  CASE WHEN state = 'resolved' THEN old_digest END AS digest
FROM j
"""


@LLM.query("op7_revisit_resolution", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.revisits import captures, resolve_revisits

    done = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit(": "), x["value"])))
    return done.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(lines, "\n")))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS digest
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(DISTINCT (doc_id, size, digest)) AS units FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
o AS (SELECT *, [1, 2, 3][i % 3 + 1] AS weight, 3 * source_size AS most FROM w),
q AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS asked
  FROM o WINDOW b AS (ORDER BY most / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(most::DOUBLE, max(asked) OVER () * weight) AS target FROM q),
x AS (SELECT *, least(most, floor(target + 0.5)::BIGINT) AS words FROM t),
p AS (
  SELECT d.*, x.source_size, x.target, x.units, CASE WHEN x.source_size = 0 THEN 0 ELSE x.words // x.source_size END AS passes,
    CASE WHEN x.source_size = 0 THEN 0 ELSE x.words % x.source_size END AS rest,
    md5(coalesce(doc_id::VARCHAR, '') || '#' || digest || '#' || (CASE WHEN x.source_size = 0 THEN 0 ELSE x.words // x.source_size END) || '#0') AS lot
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
l AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(lot, 1, 8))::BIGINT % greatest(1, units // 4096), lot, doc_id, digest, size, r) - size AS before
  FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM l
"""


@LLM.query("op11_source_mixture", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.mixing import Mixture

    mixture = Mixture(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3, block=1024)
    return mixture.documents().select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = rf"""
WITH t0 AS (SELECT i AS n, i::BIGINT AS c FROM range(256) r(i)),
t1 AS (SELECT n, list_reduce(list_prepend(c, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM t0),
crc AS (SELECT list(c ORDER BY n) AS cells FROM t1),
t AS (
  SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM t),
b AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM t),
c AS (SELECT conv_id, base, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, cells[(xor(a, x) & 255) + 1]))) % 4 AS h FROM b, crc),
r AS (
  SELECT c.conv_id, pos, id, words FROM c JOIN o USING (conv_id) WHERE pos > h OR base = c.conv_id
  UNION ALL SELECT c.conv_id, pos, id, words FROM c JOIN o ON o.conv_id = c.base WHERE base <> c.conv_id AND pos <= h),
s AS (SELECT c.conv_id, coalesce(string_agg(id, '' ORDER BY pos), '') AS path, list(words ORDER BY pos) AS words, count(id) AS depth FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, depth, path, words, unnest(range(depth + 1)) AS d FROM s),
n AS (
  SELECT substr(path, 1, 32 * d) AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE words[d] END) AS w,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = d), '') AS ends
  FROM p GROUP BY substr(path, 1, 32 * d), d),
k AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT *, unnest(range(d + 1)) AS a FROM m),
v AS (SELECT substr(path, 1, 32 * a) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM u GROUP BY substr(path, 1, 32 * a))
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN v USING (path) LEFT JOIN n q ON m.d > 0 AND q.path = substr(m.path, 1, 32 * (m.d - 1))
"""


@LLM.query("op12_conversation_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelode.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


@LLM.query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codelode.llm.alignment import alignment_summary

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment_summary(table(spark, sf_dir, "documents"), a, b)


@LLM.query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
