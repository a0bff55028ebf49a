"""The queries of this package by name, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bfd_packing,
    embedding_dedup,
    impact_search,
    language_id,
    matroska,
    mixture_packing,
    poisson_mixing,
    quality_gbt,
    reply_trees,
    sharding,
    simhash_dedup,
    sort_means,
    url_filter,
)
from .common import crc_of_id, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, remainder: int):
    return F.coalesce(crc_of_id("doc_id") % modulus == remainder, F.lit(False)).alias("held_out")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify_languages(docs, language_id.fit(docs))
    return found.select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(_table(spark, sf_dir, "documents"), words=3, distance=3)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24, grown=25)


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mixture_packing.pack_mixture(_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "source"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.filter_urls(pages, url_filter.noisy_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.floor(F.col("rate") * 1e6 + 0.5) / 1e6)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality_gbt.score_quality(docs, quality_gbt.fit(docs, labels))
    return scored.select("doc_id", _held_out(5, 0), "score", "predicted")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.pack_best_fit(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.centroid_clusters(_table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, seed=2)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = reply_trees.with_probe(_table(spark, sf_dir, "conversations"))
    return reply_trees.digests(reply_trees.format_trees(reply_trees.as_trees(turns), best=1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_language_id,
        op3_simhash_near_dedup,
        op4_matroska,
        op5_sharding,
        op6_mixture_packing,
        op7_url_filter,
        op8_poisson_mixing,
        op9_quality_classifier,
        op10_best_fit_packing,
        op11_centroid_clustering,
        op12_ranked_search,
        op13_chat_formatting,
    )
}

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in url_filter.RULES)



def _centroid_sql(clusters: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Plain k-means, a pair of CTEs a round; doubles hold these whole numbers exactly."""

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT vec_id, kept.v, k, list_dot_product(kept.v, kept.v) - 2 * list_dot_product(kept.v, c.v) + list_dot_product(c.v, c.v) AS d
            FROM kept, c{n} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""

    def moved(n: int) -> str:
        return f"""c{n} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{n - 1} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS v FROM (SELECT k, i, floor(sum(v[i]) / count(*)) AS x
            FROM a{n - 1}, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1) m USING (k))"""

    steps = [assigned(0)]
    for n in range(1, rounds + 1):
        steps += [moved(n), assigned(n)]
    chain = ",\n        ".join(steps)
    return f"""
        WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {clusters}),
        {chain}
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (k)"""


#: The others need hashes, models or formats that SQL doesn't have; tests hold
#: them against brute-force versions. The SQL of op1 compares all pairs of a
#: label, which the test tables' sizes allow; that of op5 numbers a shard's
#: rows by id, which is the order in which these tables are written.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / m) AS e FROM (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS m FROM vecs
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE m > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
        reach AS (SELECT vec_id AS u, vec_id AS r FROM vecs UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.r),
        roots AS (SELECT u, min(r) AS root FROM reach GROUP BY 1)
        SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.u = v.vec_id) AS n_links, root AS component_id, v.vec_id = root AS kept FROM vecs v JOIN roots ON roots.u = v.vec_id""",
    "op5_sharding": f"""
        WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
        bytes AS (SELECT doc_id, coalesce(strlen(text), 0) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
        sized AS (SELECT doc_id, n + 8 AS size, xor(4294967295, list_reduce(list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS crc FROM bytes, crc_table),
        jumps AS (SELECT doc_id, (CAST(coalesce(doc_id, 0) AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS key, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS grown FROM documents
            UNION ALL SELECT doc_id, next, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT), CASE WHEN j < 24 THEN j ELSE shard END, j
            FROM (SELECT *, (key * {sharding.MULTIPLIER} + 1) % 18446744073709551616 AS next FROM jumps WHERE j < 25)),
        ends AS (SELECT doc_id, shard, grown FROM jumps WHERE j >= 25)
        SELECT doc_id, size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
        FROM sized JOIN ends USING (doc_id)""",
    "op7_url_filter": f"""
        WITH raw AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM raw),
        tail AS (SELECT *, substring(rest, length(raw_host) + 1) AS after FROM split),
        parts AS (SELECT *, translate(raw_host, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(after, '^[^?#]*') AS path FROM tail),
        query AS (SELECT *, regexp_extract(substring(after, length(path) + 1), '^\\?([^#]*)', 1) AS query FROM parts),
        kept AS (SELECT *, regexp_replace(regexp_replace(query, '(^|&)(utm_[^&=]*|ref)=[^&]*', '', 'g'), '^&+', '') AS rest_query FROM query),
        urls AS (SELECT page_id, html, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN rest_query = '' THEN '' ELSE '?' || rest_query END END AS canonical FROM kept),
        listed AS (SELECT DISTINCT canonical AS c FROM urls WHERE regexp_matches(html, '(\\*\\*\\*|%%%|\\$\\$\\$|###)') AND canonical IS NOT NULL),
        rules AS (SELECT * FROM (VALUES {_RULES}) r(v, h, p)),
        fits AS (SELECT u.page_id AS pid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM urls u JOIN rules
            ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY 1)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN c IS NULL THEN 'allow' ELSE 'block' END) AS verdict, canonical, c IS NOT NULL AS listed
        FROM urls LEFT JOIN fits ON pid = page_id LEFT JOIN listed ON c = canonical""",
    "op8_poisson_mixing": f"""
        WITH sizes AS (SELECT source AS s, CAST(sum(greatest(length(text), 1)) AS DOUBLE) AS n FROM documents GROUP BY 1),
        rates AS (SELECT s, power(n, {poisson_mixing.TEMPERATURE}) / (SELECT sum(power(n, {poisson_mixing.TEMPERATURE})) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
        ks AS (SELECT unnest(range((SELECT CAST(60 + max(rate) + 12 * sqrt(max(rate)) AS BIGINT) FROM rates))) AS k),
        terms AS (SELECT s, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS term FROM rates, ks),
        cdf AS (SELECT s, rate, k, sum(term) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
        draws AS (SELECT *, CAST(('0x' || substring(md5(CAST(doc_id AS VARCHAR) || ':{poisson_mixing.SEED}'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
        counted AS (SELECT d.doc_id AS i, any_value(rate) AS rate, CAST(count(*) FILTER (u >= c) AS INTEGER) AS copies FROM draws d JOIN cdf ON s IS NOT DISTINCT FROM d.source GROUP BY 1)
        SELECT d.*, copy, copies, floor(rate * 1e6 + 0.5) / 1e6 AS rate FROM documents d JOIN counted ON i = doc_id JOIN (SELECT k AS copy FROM ks) ON copy < copies""",
    "op11_centroid_clustering": _centroid_sql(),
    "op12_ranked_search": rf"""
        WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        sizes AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM words WHERE len(t) > 0),
        lengths AS (SELECT doc_id AS d, 50 + (50 * len(t) * docs) // total AS m FROM words, sizes),
        items AS MATERIALIZED (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
        posts AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM words) WHERE term IN (SELECT term FROM items) GROUP BY 1, 2),
        weights AS (SELECT term AS w_term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM posts GROUP BY 1), sizes),
        impacts AS MATERIALIZED (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS impact FROM posts JOIN weights ON w_term = term JOIN lengths ON d = doc_id),
        scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op13_chat_formatting": rf"""
        WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, t, r, '{reply_trees.END}{reply_trees.START}assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
        turns AS (SELECT *, CASE WHEN role = 'assistant' THEN text END AS learned,
            {len(reply_trees.START + reply_trees.END) + 2} + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars FROM said)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(learned)), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(learned, '' ORDER BY turn), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM turns GROUP BY 1""",
}
