"""The registered corpus queries: opN_<name> applies operator N with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import decontamination, divergence, exact_dedup, html_text, language_id, mixing, near_dedup, quality, sharding, simhash, suffix_dedup, token_counts, vector_codes
from talkframe.llm.tables import documents

SHARDS = 40


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language_id.fold(3) == 1
    found = language_id.predict(docs, language_id.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), width=2, percent=80)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of operator 7: documents that hold a benchmark window altered, and of which items."""
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=True)
    return found.where("n_near > 0").select("doc_id", "n_near", "near_items", "contaminated")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = language_id.fold(5) == 0
    found = quality.score(docs, quality.fit(docs, labels, ~held_out), threshold=0.3)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


OPERATORS = (
    op1_token_counts, op2_exact_dedup, op3_language_id, op4_sharding, op5_mixing, op6_near_dedup, op7_decontamination, op8_suffix_dedup,
    op9_html_extraction, op10_quality, op11_vector_codes, op12_divergence, op13_simhash,
)
QUERIES = {f.__name__: f for f in (decontamination_near, *OPERATORS)}

ORACLES = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h ORDER BY length(text) DESC, doc_id)""",
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(no - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
        l AS (
            SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
                coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
                row_number() OVER (ORDER BY cap / w, no) AS rk FROM w),
        f AS (SELECT *, (budget - used) / rest AS level, cap <= (budget - used) / rest * w AS is_full FROM l),
        t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (SELECT arg_min(level, rk) FROM f WHERE NOT is_full) * w END AS target FROM f),
        r AS (
            SELECT d.*, row_number() OVER (
                PARTITION BY source ORDER BY length(bin(size)) * 8 + CASE WHEN length(bin(size)) > 3 THEN size >> (length(bin(size)) - 3) ELSE size END DESC,
                ('0x' || substr(md5(coalesce('=' || doc_id, '')), 1, 8))::BIGINT % 64, size DESC, doc_id NULLS FIRST) AS k
            FROM d),
        u AS (
            SELECT r.doc_id, r.size, t.source_size, t.target, r.k, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                ('0x' || substr(md5('mix' || coalesce('=' || r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST((floor(k * rate + u) - floor((k - 1) * rate + u)) * size AS BIGINT) AS taken FROM u""",
    "op7_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        v AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        p AS (
            SELECT doc_id, n, unnest([{'i': i, 'phrase': array_to_string(w[i : i + n - 1], ' ')} for i in range(1, len(w) - n + 2)]) AS x
            FROM d, (SELECT DISTINCT n FROM v) AS s),
        m AS (SELECT p.doc_id, x.i AS i, v.n, v.item_id FROM p JOIN v ON v.n = p.n AND x.phrase = v.phrase),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_vector_codes": r"""
        WITH x AS (
            SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        p AS (
            SELECT r, k AS part, v[k * len(v) // 16 + 1 : (k + 1) * len(v) // 16] AS c FROM x, range(16) AS t(k)),
        b0 AS (
            SELECT p.part, o.entry, p.c FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM x QUALIFY entry < 64) AS o USING (r)),
        a0 AS (
            SELECT r, part, arg_min(entry, d * 64 + entry) AS entry
            FROM (SELECT p.r, p.part, b.entry, list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i]))) AS d FROM p JOIN b0 AS b USING (part))
            GROUP BY r, part),
        m1 AS (
            SELECT part, entry, list(m ORDER BY i) AS c
            FROM (SELECT part, entry, i, floor(sum(c[i]) / count(*))::BIGINT AS m FROM (SELECT a.part, a.entry, p.c, unnest(range(1, len(p.c) + 1)) AS i FROM a0 AS a JOIN p USING (r, part)) GROUP BY part, entry, i)
            GROUP BY part, entry),
        b1 AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b0 AS b LEFT JOIN m1 AS m USING (part, entry)),
        a1 AS (
            SELECT r, part, arg_min(entry, d * 64 + entry) AS entry
            FROM (SELECT p.r, p.part, b.entry, list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i]))) AS d FROM p JOIN b1 AS b USING (part))
            GROUP BY r, part),
        m2 AS (
            SELECT part, entry, list(m ORDER BY i) AS c
            FROM (SELECT part, entry, i, floor(sum(c[i]) / count(*))::BIGINT AS m FROM (SELECT a.part, a.entry, p.c, unnest(range(1, len(p.c) + 1)) AS i FROM a1 AS a JOIN p USING (r, part)) GROUP BY part, entry, i)
            GROUP BY part, entry),
        b2 AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b1 AS b LEFT JOIN m2 AS m USING (part, entry)),
        a2 AS (
            SELECT r, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
            FROM (SELECT p.r, p.part, b.entry, list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i]))) AS d FROM p JOIN b2 AS b USING (part))
            GROUP BY r, part),
        f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
        FROM f JOIN x USING (r)""",
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (
            SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) AS g LEFT JOIN c USING (lang, source)
            GROUP BY g.lang, g.source),
        p AS (
            SELECT s.lang, s.source, k.term, c.n AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS BIGINT) AS p,
                CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS BIGINT) AS q
            FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        t AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        u AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(t.value, 0) AS BIGINT) AS value
            FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN t ON t.lang = a.lang AND t.source = a.source AND t.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u QUALIFY part = 'pair' OR rank <= 10""",
}
