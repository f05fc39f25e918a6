"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm import curriculum, exact_dedup, host_rules, jaccard_join, lexical_search, license_scan, quality_model, sentence_pieces, source_audit, suffix_dedup, token_files, warc_zip, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(manifest).withColumnRenamed("id", "doc_id")


@query("op3_exact_dedup", r"""
WITH rows AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM rows JOIN groups USING (text_sha256)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_warc_zip", r"""
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_packages(table(spark, sf_dir, "pages"))
    return warc_zip.read_records(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


@query("op7_quality_model")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), quality_model.held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


@query("op8_curriculum_positions")
def op8_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op8_curriculum with the times and positions of each document's copies in the training order."""
    placed = curriculum.training_positions(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"),
                         (F.col("size") * F.col("copies")).alias("taken"), "times", F.col("ranks").alias("positions"))


@query("op8_curriculum", r"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(':', source, doc_id::VARCHAR)) AS place FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (list_value(5.0::DOUBLE, 2.0, 1.0))[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w FROM rows GROUP BY source),
levels AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
targets AS (SELECT source, source_size, least(2.0 * source_size, w * max(level) OVER ()) AS target FROM levels),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS supplied FROM rows)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       (size * ((2 * supplied + size <= 2 * target)::INT + (2 * (source_size + supplied) + size <= 2 * target)::INT))::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = curriculum.positions(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"),
                         (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_host_rules", r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM docs WHERE len(ws) >= 3),
keyed AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS w FROM windows),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM docs LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM failed WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(n) AS size FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE greatest(1.0, size) END AS s FROM moments),
verdicts AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM failed LEFT JOIN verdicts USING (source)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), *host_rules.COUNTS, "base_failed", "kept")


@query("op10_sentence_pieces")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = sentence_pieces.round_trip(table(spark, sf_dir, "documents"), pieces)
    return found.select(F.col("id").alias("doc_id"), F.col("n_ids").alias("n_tokens"), "ids_crc32", "n_chars_back", "restored")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("op5_license_scan", r"""
WITH templates AS (SELECT * FROM (VALUES """ + ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in license_scan.TEMPLATES.items()) + r""") AS v(licence, body)),
tw AS (SELECT licence, regexp_extract_all(lower(body), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM templates),
tp AS (SELECT licence, ws, unnest(range(1, len(ws))) AS i FROM tw),
tg AS (SELECT licence, ws[i] || ' ' || ws[i + 1] AS g, count(*) AS n FROM tp GROUP BY ALL),
ts AS (SELECT licence, sum(n) AS size FROM tg GROUP BY licence),
docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lw AS (SELECT doc_id, k, regexp_extract_all(lower(l), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM docs)),
worded AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM lw WHERE len(ws) > 0),
units AS (SELECT doc_id, 'line' AS unit, k AS first_line, k AS last_line, ws FROM worded
    UNION ALL SELECT doc_id, 'block', min(k), max(k), flatten(list(ws ORDER BY k)) FROM worded GROUP BY doc_id, island HAVING count(*) > 1
    UNION ALL SELECT doc_id, 'text', min(k), max(k), flatten(list(ws ORDER BY k)) FROM worded GROUP BY doc_id HAVING count(DISTINCT island) > 1),
up AS (SELECT doc_id, unit, first_line, last_line, ws, unnest(range(1, len(ws))) AS i FROM units WHERE len(ws) > 1),
ug AS (SELECT doc_id, unit, first_line, last_line, len(ws) - 1 AS size, ws[i] || ' ' || ws[i + 1] AS g, count(*) AS n FROM up GROUP BY ALL),
shared AS (SELECT doc_id, unit, first_line, last_line, ug.size, licence, sum(least(ug.n, tg.n)) AS n FROM ug JOIN tg USING (g) GROUP BY ALL),
scored AS (SELECT *, 2 * shared.n / (shared.size + ts.size) AS score FROM shared JOIN ts USING (licence))
SELECT doc_id, unit, first_line::INT AS first_line, last_line::INT AS last_line, licence, round(score, 6) AS score FROM scored WHERE score >= 0.7
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, first_line, last_line ORDER BY score DESC, licence) = 1""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), passages=True)
    return found.withColumnRenamed("id", "doc_id").withColumn("score", F.round("score", 6))


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), k=3, percent=90)
    return jaccard_join.component_ids(groups).withColumnRenamed("id", "doc_id")


@query("op13_winnowing", r"""
WITH items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
places AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, list_slice(ws, i, i + n - 1) AS w FROM places),
sizes AS (SELECT DISTINCT len(w) AS n FROM windows),
grams AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, sizes)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (w)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op12_source_audit", r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
tokens AS (SELECT r, lang, source, unnest(ws) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
own AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
shares AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (total + v))::BIGINT AS p FROM cells JOIN own USING (lang, source) JOIN v USING (lang)),
whole AS (SELECT lang, sum(total) AS total FROM own GROUP BY lang),
base AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 1)) // any_value(total + v))::BIGINT AS q FROM cells JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares JOIN base USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query("op11_lexical_search", r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
whole AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM docs WHERE len(ws) > 0),
per AS (SELECT r, doc_id, 75 + (25 * len(ws) * n_docs) // n_terms AS m FROM docs, whole WHERE len(ws) > 0),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), whole GROUP BY item_id, term, n_docs, df),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM wanted JOIN tf USING (term) JOIN per USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return found.withColumnRenamed("id", "doc_id")
