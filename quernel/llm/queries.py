"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, jaccard, licenses, mixing, quality_model, quality_rules, topk, toxicity, warc
from .common import Scratch, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), same_length=False)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), Scratch(spark)).drop("class_id", "component", "text_hash")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark)).drop("reasons")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark)).drop("status")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.documents_as_files(table(spark, sf_dir, "documents")), Scratch(spark), carry=("doc_id",))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_topk": op1_topk, "op2_jaccard": op2_jaccard, "op3_mixing": op3_mixing, "op4_quality_rules": op4_quality_rules, "op5_bpe": op5_bpe, "op6_toxicity": op6_toxicity, "op7_warc": op7_warc, "op8_licenses": op8_licenses, "op9_quality_model": op9_quality_model, "op10_html": op10_html}
ORACLES: dict[str, str] = {
    "op1_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT v, b FROM r JOIN e ON u = a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v) c USING (doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, upper(sha1(coalesce(html, ''))) AS h FROM pages),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
              array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + CAST(((CAST('0x' || substr(h, 1 + 5 * CAST(floor(k / 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), '') AS digest FROM p)
        SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to FROM t""",
    "op4_quality_rules": f"""
        WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS g FROM w WHERE len(w) >= 9),
        q AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        r AS (SELECT doc_id, count(DISTINCT x) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS x FROM q) GROUP BY doc_id),
        f AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
        x AS (SELECT doc_id, lang, base_failed, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
              unnest([n_symbols / nullif(word_chars, 0), n_dup_lines / nullif(len(l), 0), n_repeat_words / nullif(n_words, 0), word_chars / nullif(n_words, 0)]) AS v FROM b),
        c(rate, cutoff) AS (VALUES {", ".join(f"('{r}', CAST({c} AS DOUBLE))" for r, g in quality_rules.GRIDS.items() for c in g)}),
        y AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        s AS (SELECT lang, rate, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND v > cutoff) AS k, count(*) FILTER (quality = 0 AND v > cutoff) AS bad
              FROM x JOIN y USING (doc_id) JOIN c USING (rate) WHERE NOT base_failed GROUP BY ALL),
        t AS (SELECT *, count(*) OVER () AS tests FROM s),
        a AS (SELECT * FROM t WHERE n > 0 AND bad > k AND k < n * 0.005
              AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))) <= 0.05 / tests),
        o AS (SELECT lang, rate, cutoff FROM a QUALIFY row_number() OVER (PARTITION BY lang, rate ORDER BY bad - k DESC, cutoff DESC) = 1),
        d AS (SELECT DISTINCT doc_id FROM x JOIN o USING (lang, rate) WHERE v > cutoff)
        SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND d.doc_id IS NULL AS kept FROM b LEFT JOIN d ON d.doc_id = b.doc_id""",
}
