"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fingerprints import as_text, containment, distinct_shingles, edited_pairs, resemblance
from .langid import language_id
from .licenses import license_scan
from .lmscore import score_documents
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack_documents
from .quality import STOP_WORDS, THRESHOLDS, quality_rules
from .suffixdedup import dedup_passages
from .warc import warc_round_trip


def tokenizer_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op1_sql():
    stop = ", ".join("'" + x + "'" for x in sorted({x for v in STOP_WORDS.values() for x in v.split()}))
    rules = " AND ".join(
        f"{name} {op} {bound}" for name, low, high in THRESHOLDS for op, bound in ((">=", low), ("<=", high)) if bound is not None
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
dup AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: trim(lower(x), '.,;:!?"''()') IN ({stop}))) AS n_stop, len(l) AS n_lines,
             len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis,
             len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullets,
             length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
             length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
             CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_line_ratio,
             CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio,
             CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0 END AS upper_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM r
"""


def op2_suffix_dedup(spark, sf_dir):
    d = dedup_passages(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_lm_score(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_license_scan(spark, sf_dir):
    out = license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_fingerprints(spark, sf_dir):
    d = edited_pairs(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_within"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


def op8_warc(spark, sf_dir):
    out = warc_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP8_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
"""


def op9_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_texts")


def op10_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mix_sources": op5_mix_sources,
    "op6_license_scan": op6_license_scan,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc": op8_warc,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language_id": op10_language_id,
}
ORACLES = {
    "op1_quality_rules": _op1_sql(),
    "op8_warc": _OP8_SQL,
}
