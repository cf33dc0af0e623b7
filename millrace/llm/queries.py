"""One query per operator over its whole table, with production parameters, and the equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bytepairs, mixing, passages, pieces, quality, repeats, search, simhash, templates, turns, urls, whitening
from millrace.llm.common import kept, table
from millrace.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(spark, folder)

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return run

    return register


WORD = r"[^\x20\x09-\x0D]+"
WORDS_OF = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


@query(f"""
WITH w AS (SELECT doc_id, {WORDS_OF} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
t AS (SELECT doc_id, i, ls[i + 1] AS l FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM w)),
n AS (SELECT doc_id, source, i, lower(trim(l)) AS h, length(l) AS c FROM t JOIN documents USING (doc_id)),
f AS (SELECT source, h, min(doc_id) AS first_doc FROM n WHERE c > 0 GROUP BY ALL HAVING count(DISTINCT doc_id) > 10),
g AS (SELECT doc_id, sum(c) AS gone FROM n JOIN f USING (source, h) WHERE c > 0 AND doc_id <> first_doc GROUP BY ALL),
wi AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
tw AS (SELECT doc_id, i FROM wi QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tw, range(5) AS r(k) GROUP BY ALL),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM t WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone, length(coalesce(text, '')) AS nc
  FROM w JOIN documents USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND NOT (nc - gone < 0.3 * nc) AS kept, gone::BIGINT AS removed_chars FROM m
""")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents")).drop("__host", "removed_lines")


@query(f"""
WITH d AS (SELECT doc_id, source, len({WORDS_OF}) AS size, substr(md5('17:' || doc_id), 1, 16) AS h FROM documents),
s AS (SELECT source, sum(size) AS n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * n AS cap, coalesce(sum(2.0::DOUBLE * n) OVER before, 0) AS full_before,
  sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free
  FROM s WINDOW before AS (ORDER BY 2.0::DOUBLE * n / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
l AS (SELECT arg_min((1.5::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE - full_before) / free, cap / w) FILTER
  ((1.5::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE - full_before) / free <= cap / w) AS level FROM c),
t AS (SELECT source, n, least(w * level, cap) AS target FROM c, l),
u AS (SELECT *, floor(target / n)::BIGINT AS whole, target - floor(target / n) * n AS rest FROM t),
o AS (SELECT d.*, n, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) - size AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
e AS (SELECT source, rest - before AS room, h AS eh, doc_id AS ed FROM o WHERE before <= rest AND before + size > rest),
x AS (SELECT o.*, room, before + size <= rest AS early,
  row_number() OVER (PARTITION BY o.source ORDER BY CASE WHEN before + size > rest AND abs(size - room) < room THEN 0 ELSE 1 END, abs(size - room), h, doc_id) AS r
  FROM o LEFT JOIN e ON o.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
  (size * least(2, whole + CASE WHEN early OR (r = 1 AND abs(size - room) < room AND before + size > rest) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
""")
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, folder, "documents"))


@query("""
WITH l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
m AS (SELECT doc_id, i, regexp_extract_all(regexp_replace(ls[i + 1], '[0-9]+', '<*>', 'g'), '[^\\x20\\x09-\\x0D]+') AS t FROM l),
k AS (SELECT *, len(t) AS n, t[1:4] AS lead FROM m WHERE len(t) > 0),
r AS (SELECT n, lead FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
h AS (SELECT k.* FROM k JOIN r USING (n, lead)),
p AS (SELECT n, lead, p, t[p] AS tok, count(*) AS c FROM (SELECT *, unnest(range(5, n + 1)) AS p FROM h) GROUP BY ALL),
q AS (SELECT n, lead, p, max_by(tok, (c, tok)) AS tok FROM p GROUP BY n, lead, p HAVING 2 * max(c) >= sum(c)),
f AS (SELECT n, lead, list(p) AS ps, list(tok) AS ts FROM q GROUP BY n, lead),
a AS (SELECT n, lead, coalesce(ps, []) AS ps, coalesce(ts, []) AS ts FROM r LEFT JOIN f USING (n, lead)
  WHERE coalesce(len(ps), 0) + least(4, n) >= 0.7 * n AND n > 4),
z AS (SELECT h.doc_id, h.i, CASE WHEN a.n IS NOT NULL AND list_transform(ps, lambda x: t[x]) = ts THEN {'k': 1, 'n': h.n, 't': h.lead} ELSE {'k': 2, 'n': h.n, 't': t} END AS z
  FROM h LEFT JOIN a ON h.n = a.n AND h.lead = a.lead),
s AS (SELECT z, min((doc_id, i)) AS first_line FROM z GROUP BY z HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT doc_id, i FROM z JOIN s USING (z) WHERE (doc_id, i) <> first_line)
SELECT doc_id, any_value(len(ls))::BIGINT AS n_lines, count(g.i)::BIGINT AS n_dropped,
  coalesce(string_agg(ls[l.i + 1], chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id
""")
def op3_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.drop_recurring_lines(table(spark, folder, "documents"), counts=True)


@query()
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""")
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]


@query(r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
t AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*([^"''\s>]+)', 1)]) AS link FROM p),
e AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS a, regexp_replace(CASE WHEN link LIKE '/%' THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || link ELSE link END, '#.*$', '') AS b
  FROM t WHERE link <> '' AND contains(url, '://')),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS node, a AS other FROM b UNION SELECT c.node, b.b FROM c JOIN b ON c.other = b.a),
n AS (SELECT DISTINCT node, other, regexp_extract(other, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(other, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM c),
f AS (SELECT node, arg_max(k.verdict, length(k.host) + length(k.path)) AS v FROM n JOIN k ON (n.host = k.host OR n.host LIKE '%.' || k.host) AND starts_with(n.path, k.path)
  GROUP BY node, other),
g AS (SELECT node, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM f GROUP BY node),
r AS (SELECT p.page_id, p.url, p.host, p.path, arg_max(k.host || k.path, length(k.host) + length(k.path)) AS rule,
  arg_max(k.verdict, length(k.host) + length(k.path)) AS v
  FROM p LEFT JOIN k ON (p.host = k.host OR p.host LIKE '%.' || k.host) AND starts_with(p.path, k.path) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(r.v, g.v, 'allow') AS verdict FROM r LEFT JOIN g ON g.node = regexp_replace(r.url, '#.*$', '')
""")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query()
def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(table(spark, folder, "documents"), pieces.Segmenter(pieces.load_vocabulary(VOCABULARY)))


@query()
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.token_counts(table(spark, folder, "documents"), pieces.Segmenter(pieces.load_vocabulary(VOCABULARY)))


@query()
def op5_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_near_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_passages(table(spark, folder, "documents"))


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def op11_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    codec = bytepairs.Codec(spark, RANKS)
    both = bytepairs.decoded(bytepairs.encoded(table(spark, folder, "documents"), codec, packed=True), codec)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query()
def op13_whitened(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query("""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'id': id, 'chars': chars} ORDER BY turn NULLS FIRST, id) AS ts,
  [4294967295::BIGINT] || flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ord((conv_id::VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])) AS bits
  FROM t GROUP BY conv_id),
c AS (SELECT conv_id, ts, xor(list_reduce(bits, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM o),
r AS (SELECT c.conv_id, coalesce(b.ts[1:c.h], []) || c.ts[c.h + 1:] AS ts FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS k FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
g AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS e FROM m GROUP BY k, d),
b AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * g.k[d].chars END AS own FROM g LEFT JOIN b ON g.k = b.k),
a AS (SELECT k[1:j] AS k, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM f) GROUP BY k[1:j])
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(f.e) AS ends_sha256
FROM f JOIN a ON f.k = a.k LEFT JOIN f p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turns.prefix_trie(turns.rebuilt(kept(turns.numbered(table(spark, folder, "conversations")))))
