"""The registered queries of this subpackage, with production parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread
from . import ann, decontam, html_extract, line_dedup, minhash, packing, secret_scan, token_output, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, over all cores even if it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), with_text=False).drop("text")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_output": op5_token_output,
    "op6_minhash": op6_minhash,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_nearest": op10_nearest,
    "pipeline": pipeline,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    # the tables' pages keep their text in one article of h1 and p elements
    "op1_html_extract": r"""
        WITH a AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
        b AS (
            SELECT page_id, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
                replace(replace(replace(replace(regexp_replace(replace(regexp_replace(x, '<br>', ' ', 'g'), '<b>', ''), '<[^>]*>', '', 'g'),
                    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'))) AS blocks FROM a)
        SELECT a.page_id, a.url, t.text, length(t.text)::BIGINT AS n_chars
        FROM a JOIN (SELECT page_id, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)), '') AS text FROM b) t ON a.page_id = t.page_id""",
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
        repeated AS (
            SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT keyed.*, (repeated.k IS NOT NULL AND keyed.doc_id <> repeated.top) AS dropped
            FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op6_minhash": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
            FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair_counts AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pair_counts JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach(doc_id, r) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
        top AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT top.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, top.doc_id = component_id AS kept
        FROM top LEFT JOIN n ON n.doc_id = top.doc_id""",
    "op8_decontaminate": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM windows),
        spots AS (
            SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
            FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i) WHERE len(w) >= size),
        hits AS (SELECT s.doc_id, s.i, s.size, x.item_id FROM spots s JOIN windows x ON s.win = x.win AND s.size = x.size),
        hit_words AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
               sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id""",
    "op10_nearest": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
