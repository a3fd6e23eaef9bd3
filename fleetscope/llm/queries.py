"""The registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import pii_spans, secret_scan
from fleetscope.llm.byte_bpe import encode_documents
from fleetscope.llm.common import documents
from fleetscope.llm.exact_dedup import exact_duplicates
from fleetscope.llm.fill_in_middle import fill_in_middle, restored
from fleetscope.llm.lm_scoring import score_documents
from fleetscope.llm.ngram_join import jaccard_components
from fleetscope.llm.quality_rules import quality_verdicts
from fleetscope.llm.sequence_packing import pack_documents
from fleetscope.llm.source_mix import mix_sources
from fleetscope.llm.substring_dedup import remove_duplicate_passages
from fleetscope.llm.token_alignment import score_alignments
from fleetscope.llm.token_counts import count_tokens


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("copies")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_documents(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind.name}") for rank, kind in enumerate(secret_scan.KINDS) if kind.base],
        F.sha2(secret_scan.text_of(F.col("base")), 256).alias("base_sha256"),
        secret_scan.text_of(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_duplicate_passages(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans.find_personal_data(documents(spark, sf_dir))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{name}") for rank, name in enumerate(pii_spans.BASE)],
        F.sha2(pii_spans.text_of(F.col("base")), 256).alias("base_sha256"),
        pii_spans.text_of(F.col("spans")).alias("spans"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), seed=7, percent=100, spm_percent=50)
    return restored(made).select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = score_alignments(documents(spark, sf_dir), *files, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048, end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pii_spans": op6_pii_spans,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_sequence_packing": op13_sequence_packing,
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
        ), g AS (
            SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content
        )
        SELECT n.doc_id, g.keep_id, g.group_size, sha256(n.content) AS text_sha256,
               n.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY n.doc_id, content) = 1 AS kept
        FROM n JOIN g USING (content)
    """,
    "op5_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), p AS (
            SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35
        ), k AS (
            SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM p
        ), d AS (
            SELECT doc_id, s FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)
        ), c AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM d
        ), t AS (
            SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
        ), l AS (
            SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept, count(*) AS n_kept
            FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i WHERE c.i IS NULL GROUP BY t.doc_id
        )
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id)
    """,
    "op9_quality_rules": r"""
        WITH w AS (
            SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), k AS (
            SELECT doc_id, s, array_to_string(ws[s:s + 7], ' ') AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS s FROM w WHERE len(ws) >= 8)
        ), r AS (
            SELECT doc_id, count(DISTINCT i) AS n FROM (
                SELECT doc_id, unnest(range(s, s + 8)) AS i FROM k JOIN (
                    SELECT doc_id, h FROM k GROUP BY doc_id, h HAVING count(*) > 1) USING (doc_id, h)) GROUP BY doc_id
        ), f AS (
            SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN r USING (doc_id)
        ), b AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
        ), ladder(rule, cut, s) AS (
            SELECT rule, cut::DOUBLE, row_number() OVER () FROM (VALUES
                ('symbols', 0.5), ('long_words', 40.0), ('symbols', 0.3), ('long_words', 24.0), ('symbols', 0.2), ('long_words', 16.0),
                ('symbols', 0.1), ('long_words', 12.0), ('symbols', 0.05), ('long_words', 10.0), ('symbols', 0.02), ('long_words', 8.0),
                ('symbols', 0.01), ('long_words', 7.0), ('dup_lines', 0.9), ('repeats', 0.25), ('dup_lines', 0.7), ('repeats', 0.2),
                ('dup_lines', 0.5), ('repeats', 0.15), ('dup_lines', 0.3), ('repeats', 0.1), ('dup_lines', 0.2), ('repeats', 0.05),
                ('dup_lines', 0.1)) t(rule, cut)
        ), x AS (
            SELECT doc_id, lang, base_failed, unnest([
                {'rule': 'symbols', 'v': n_symbols / greatest(word_chars, 1)}, {'rule': 'dup_lines', 'v': n_dup_lines / greatest(n_lines, 1)},
                {'rule': 'repeats', 'v': n_repeat_words / greatest(n_words, 1)}, {'rule': 'long_words', 'v': word_chars / greatest(n_words, 1)}],
                recursive := true)
            FROM b
        ), first AS (
            SELECT x.doc_id, min(s) AS s FROM x JOIN ladder USING (rule) WHERE v > cut GROUP BY x.doc_id
        ), truth AS (
            SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
        ), labelled AS (
            SELECT b.lang, good, first.s AS hit FROM b JOIN truth USING (doc_id) LEFT JOIN first USING (doc_id) WHERE NOT base_failed
        ), sized AS (
            SELECT lang, 0.975 ** count(*) FILTER (good) > 0.05 / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM labelled) AS few
            FROM labelled GROUP BY lang
        ), pooled AS (
            SELECT few, CASE WHEN few THEN NULL ELSE l.lang END AS pool, good, hit FROM labelled l JOIN sized z ON z.lang IS NOT DISTINCT FROM l.lang
        ), counts AS (
            SELECT few, pool, ladder.s, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS m, count(*) FILTER (good AND hit <= ladder.s) AS k,
                   count(*) FILTER (NOT good AND hit <= ladder.s) AS bad FROM pooled, ladder GROUP BY ALL
        ), tested AS (
            SELECT few, pool, s, bad / greatest(m, 1) - k / greatest(n, 1) AS gain, k <= n * 0.025 AND list_sum(list_transform(range(0, k + 1), lambda j:
                       exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.025) + (n - j) * ln(0.975))))
                       <= 0.05 / (SELECT count(*) FROM sized) AS passes
            FROM counts
        ), step AS (
            SELECT few, pool, first(s ORDER BY gain DESC, s) AS s FROM tested WHERE passes AND gain > 0 GROUP BY ALL
        ), used AS (
            SELECT z.lang, step.s FROM sized z JOIN step ON step.few = z.few AND (z.few OR step.pool IS NOT DISTINCT FROM z.lang)
        )
        SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce(first.s > used.s, true) AS kept
        FROM b LEFT JOIN first USING (doc_id) LEFT JOIN used ON used.lang IS NOT DISTINCT FROM b.lang
    """,
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), l AS (
            SELECT p.a, p.b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other
        ), c AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), u AS (
            SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls,
                   ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4
            FROM d
        ), c AS (
            SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS lo, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS hi,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ), p AS (
            SELECT *, array_to_string(ls[1:lo], '') AS pre, array_to_string(ls[lo + 1:hi], '') AS mid, array_to_string(ls[hi + 1:n], '') AS suf FROM c
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                                ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}
