"""Registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import table
from .decontaminate import find_contamination, is_contaminated
from .exact_dedup import DedupIndex
from .html_text import extract_main_text
from .jaccard_join import similar_documents
from .language import identify
from .lexical import search
from .licenses import detect, summarise
from .lines import drop_repeated_lines
from .mixing import mix_sources
from .negatives import ANCHOR_EVERY, mine_negatives
from .quality import THRESHOLD, score_quality
from .secret_scan import BASE_KINDS, scan_versions, span_text
from .substrings import repeated_passages


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = DedupIndex(table(spark, sf_dir, "documents")).classes()
    return classes.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(detect(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents"))

    def of(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col("path").alias("doc_id"), *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "duplicate_words", F.size("passages").cast("bigint").alias("n_passages"),
        F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["partner"]))).alias("partner_ids"), "passages",
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "source", "language", "topic", "tokens",
        F.round("multiplier", 6).alias("multiplier"), F.round("expected", 6).alias("expected"), "copies",
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine_negatives(rows, F.col("id") % ANCHOR_EVERY == 0)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LLM_QUERIES = {
    "op1_html_text": op1_html_text,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op7_language": op7_language,
    "op6_secret_scan": op6_secret_scan,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_mix_sources": op9_mix_sources,
    "op10_decontaminate": op10_decontaminate,
    "op2_exact_dedup": op2_exact_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
}

LLM_ORACLE = {
    "op9_mix_sources": mixing.oracle_sql(),
    "op10_decontaminate": rf"""
        WITH b AS (SELECT item_id, regexp_extract_all({SQL_LOWER}, '{SQL_LETTERS}') AS w FROM benchmark),
        bs AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2),
                   lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM bs),
        d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '{SQL_LETTERS}') AS w FROM documents),
        dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
                   unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
               FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
        hits AS (SELECT DISTINCT doc_id, pos, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                   FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op2_exact_dedup": f"""
        WITH t AS (
            SELECT doc_id, sha256({SQL_LOWER}) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_ranked_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '{SQL_LETTERS}') AS w FROM documents),
        s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
        b AS (SELECT item_id, term, count(*) AS times
              FROM (SELECT item_id, unnest(regexp_extract_all({SQL_LOWER}, '{SQL_LETTERS}')) AS term FROM benchmark) GROUP BY ALL),
        p AS (SELECT doc_id, n, term, count(*) AS tf
              FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) SEMI JOIN b USING (term) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        g AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                     * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
              FROM p JOIN f USING (term) JOIN b USING (term), s GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
              FROM g WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
                     list_inner_product(a.v, o.v)::BIGINT AS score
              FROM e a JOIN e o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id AND len(a.v) = len(o.v)),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same),
        n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score,
                     s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.place <= 5
                   AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, coalesce(doc_id <> keep_id, false) AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
