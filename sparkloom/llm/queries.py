"""The operators' queries over whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import alignment, decontam, divergence, html_text, lang_id, lattice_lm, near_dup, packing, quality_rules, sharding, substring_dedup, url_filter, warc
from sparkloom.llm.store import new_path

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(packing.pack(table(spark, sf_dir, "documents")))


def pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lang_id.held_out(F.col("doc_id"))
    model = lang_id.train(docs.where(~held))
    return lang_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lattice_lm.held_out(F.col("doc_id"))
    out = lattice_lm.score_texts(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_url_filter, op3_sharding, op4_language_id, op5_quality_rules, op6_decontamination, op7_html_text, op8_warc, op9_lm_scoring, op10_near_duplicates, op11_substring_dedup, op12_source_divergence, op13_token_alignment)
}


def _host(u: str) -> str:
    return rf"CASE WHEN instr({u}, '://') > 0 THEN translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"


def _path(u: str) -> str:
    return rf"CASE WHEN instr({u}, '://') > 0 THEN regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END"


_NODE = r"host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(u, '^[^#]*?(\?[^#]*)', 1, 's')"

ORACLE_SQL: dict[str, str] = {
    # Rules, then what hangs together by canonical links and refreshes, found by following links to a fixed point.
    "op2_url_filter": rf"""
        WITH RECURSIVE rules(rule, verdict, rh, rp) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
            ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
        p AS (SELECT page_id, url AS u, {_host('url')} AS host, {_path('url')} AS path, regexp_extract(coalesce(url, ''), '^([^:]*):', 1) AS scheme,
            regexp_extract(regexp_extract(coalesce(html, ''), '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'i'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i') AS href,
            regexp_extract(regexp_extract(coalesce(html, ''), '<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'i'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'i') AS goes FROM pages),
        t AS (SELECT *, unnest([href, goes]) AS t FROM p),
        l AS (SELECT u AS src, replace(CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t
            ELSE scheme || '://' || host || regexp_extract(path, '^(.*/)?', 0, 's') || t END, '&amp;', '&') AS dst FROM t WHERE t <> '' AND host <> ''),
        ends AS (SELECT DISTINCT u, {_host('u')} AS host, {_path('u')} AS path FROM (SELECT src AS u FROM l UNION ALL SELECT dst FROM l)),
        named AS (SELECT u, host, path, {_NODE} AS node FROM ends WHERE host <> ''),
        e AS (SELECT a.node AS a, b.node AS b FROM l JOIN named a ON a.u = src JOIN named b ON b.u = dst),
        ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, ways.b FROM reach r JOIN ways ON r.b = ways.a),
        ranked AS (SELECT named.node, verdict, row_number() OVER (PARTITION BY named.u ORDER BY length(rule) DESC, rule) AS r FROM named JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
        bad AS (SELECT DISTINCT reach.a AS node FROM reach JOIN ranked ON reach.b = ranked.node WHERE r = 1 AND verdict = 'block'),
        hit AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS r
            FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT p.page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN host <> '' AND {_NODE} IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END AS verdict
        FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND hit.r = 1""",
    # Items and documents by exact containment of distinct five-word shingles.
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+') IF x <> ''] AS w FROM documents),
        i AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+') IF x <> ''] AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)]) AS s FROM d),
        s AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)]) AS s FROM i),
        n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id),
        c AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN s USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, shared, item_shingles, CAST(shared AS DOUBLE) / item_shingles AS containment
        FROM c JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles""",
    # WARC: what the round trip must give, from the pages themselves.
    "op8_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
    # Every 20-word window against the first document and place where its words start.
    "op11_substring_dedup": r"""
        WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+') IF x <> ''] AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS k, unnest([array_to_string(w[k:k+19], ' ') FOR k IN range(1, len(w) - 18)]) AS s FROM d),
        r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM s),
        g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM r WHERE n > 1),
        b AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
        e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
        t AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.k) AS t FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_source_divergence": divergence.ORACLE_SQL,
}
