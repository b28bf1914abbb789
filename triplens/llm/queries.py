"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplens.llm import bpe, html, lines, minhash, mixing, quality, shallot, shards, suffixes, tokens, toxicity, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP6 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
d AS (SELECT *, row_number() OVER () AS r FROM w),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, text, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
            OR 2 * n_dup_lines > lines
            OR 2 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[!?]{2,}([\x20\x09-\x0D]|$)')) > n_words
            OR 10 * len(regexp_extract_all(text, '\p{L}[^\x20\x09-\x0D]*')) < 7 * n_words
            OR 10 * len(regexp_extract_all(text, '(\.\.\.|\x{2026})(\n|$)')) > 3 * lines
            OR 10 * len(regexp_extract_all(text, '(^|\n)[-*\x{2022}]')) > 9 * lines) AS kept
FROM b
"""


@query("op6_quality_rules", OP6)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    measured = quality.measures(table(spark, folder, "documents"))
    rules = [rule for rule, _, _ in quality.order_rules(measured)]
    return quality.cascade(measured, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


OP3 = """
WITH RECURSIVE bits(b, c, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS c FROM bits WHERE k = 8),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
hx AS (SELECT r, strlen(text) AS n, hex(encode(text)) AS h FROM t),
x AS (SELECT r, list(('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT ORDER BY i) AS x
      FROM (SELECT r, h, unnest(range(n)) AS i FROM hx) GROUP BY r UNION ALL SELECT r, [] FROM hx WHERE n = 0),
sums AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, b: xor(c >> 8, crc.c[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
         FROM x, crc),
s AS (SELECT r, i, -1.0 / ln((('0x' || substr(md5(k || '|' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS s
      FROM t, range(17) u(i)),
a AS (SELECT r, arg_max(i, (s, -i)) FILTER (i < 16) AS shard, arg_max(i, (s, -i)) AS grown_shard FROM s GROUP BY r)
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), strlen(text), text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM t JOIN sums USING (r) JOIN a USING (r)
"""


@query("op3_rendezvous_shards", OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = shards.assign(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _level(name: str, parents: str, keys: str, weight: str, above: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    join = f"JOIN {above} USING ({parents})" if parents else f"CROSS JOIN {above}"
    return f"""
{name}_n AS (SELECT {keys}, sum(tokens)::HUGEINT AS tokens, (2 * sum(tokens))::HUGEINT AS cap FROM leaf GROUP BY ALL),
{name}_w AS (SELECT n.*, total, {weight} AS w, {keys.split(', ')[-1]} AS name FROM {name}_n n {join}),
{name}_o AS (SELECT *, cap * sum(w) OVER ({by} ORDER BY cap::DOUBLE / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
             <= w * (total - coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_
             FROM {name}_w),
{name}_b AS (SELECT {keys}, tokens, CASE WHEN full_ THEN cap ELSE
             (w * (total - coalesce(sum(cap) FILTER (full_) OVER ({by}), 0))) // (sum(w) FILTER (NOT full_) OVER ({by})) END AS total FROM {name}_o)"""


OP5 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, 'other') AS lang, coalesce(source, 'other') AS source,
                  CASE WHEN regexp_full_match(source, 'src[0-7]') THEN 'web' WHEN regexp_full_match(source, 'src(8|9|10|11|12|13)') THEN 'books'
                       WHEN regexp_full_match(source, 'src(14|15|16|17|18|19)') THEN 'forums' ELSE 'other' END AS domain,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
                  coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS id FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM t GROUP BY ALL),
root AS (SELECT ((sum(tokens) * 50) // 100)::HUGEINT AS total FROM leaf),
{_level("d", "", "domain", "CASE domain WHEN 'web' THEN 50 WHEN 'books' THEN 30 WHEN 'forums' THEN 20 ELSE 5 END", "root")},
{_level("g", "domain", "domain, lang", "CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 10 ELSE 5 END", "(SELECT domain, total FROM d_b)")},
{_level("s", "domain, lang", "domain, lang, source", "5", "(SELECT domain, lang, total FROM g_b)")},
p AS (SELECT domain, lang, source, (total // tokens)::INT AS epochs, (total % tokens)::BIGINT AS rest FROM s_b WHERE tokens > 0),
u AS (SELECT *, md5('7|' || epochs || '|' || id) AS h FROM t JOIN p USING (domain, lang, source) WHERE n_tokens > 0),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM u)
SELECT doc_id, domain, lang, source, n_tokens, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies
FROM c WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


@query("op5_source_mixing", OP5)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mixed(table(spark, folder, "documents"))
    return out.select("_row.doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query("op10_fuzzy_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), min_words=1)
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"))


@query("op8_bpe_tree")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    out = bpe.encode(table(spark, folder, "documents"), bpe.vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op4_embedding_near_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


@query("op1_site_style_tree")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = html.extract(table(spark, folder, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_toxic_segments")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_section_tokens")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = tokens.section_tokens(table(spark, folder, "documents"), *tokens.vocabulary())
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def _clustered(k: int, rounds: int) -> str:
    """SQL that assigns every vector to the nearest centroid, round by round."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    parts = [
        """
v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x, row_number() OVER () AS r FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null')), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT r, v.vec_id, v.x, c.c, {distance} AS d FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, 65) t(i) GROUP BY c, i)")
            parts.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)")
    return f"""WITH {", ".join(p + "" for p in parts)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


@query("op11_shallot_clusters", _clustered(shallot.CLUSTERS, shallot.ROUNDS))
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return shallot.clusters(table(spark, folder, "embeddings"))


@query("op12_chebyshev_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_prefix_doubling")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
