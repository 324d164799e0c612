"""The contract queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_dedup, html_extract, langid, minhash_forest, mixing, packing, pii, toxicity, url_filter
from .common import held_out, table

# Rules of the URL contract and listed hosts (fixed values): host, path prefix, kind, verdict.
URL_RULES = [("org", "/", "rule", "allow"), ("example.org", "/es/", "rule", "block"), ("example.org", "/en/1", "rule", "block"), ("com", "/fr/", "rule", "allow"), ("com", "/de/", "rule", "block")]
URL_LIST = [(f"{name}.example.{tld}", "/", "list", "block") for name in ("ads-track", "cheap-pills", "spam-farm") for tld in ("com", "net", "org")]


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES + URL_LIST, "host string, path string, kind string, verdict string")
    got = url_filter.match(table(spark, sf_dir, "pages"), listed)
    return got.select("page_id", "host", "path", F.when(F.col("kind") == "rule", F.col("entry")).alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("node") % 20 == 0, 20)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_html_extract, op4_url_filter, op5_minhash_dedup, op6_language_id, op7_best_fit_packing, op8_embedding_dedup, op9_source_mixing, op10_nearest_neighbours)}

_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_UNDER = lambda h: f"(host = '{h}' OR host LIKE '%.{h}')"
_RULES = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
_BY_RULE = lambda value: " ".join(f"WHEN {_UNDER(h)} AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, _, v in _RULES)

ORACLE_SQL = {
    "op4_url_filter": f"""
        WITH u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
        SELECT page_id, host, path, CASE {_BY_RULE(lambda h, p, v: h + p)} END AS rule,
          CASE {_BY_RULE(lambda h, p, v: v)} WHEN starts_with(path, '/') AND ({' OR '.join(_UNDER(r[0]) for r in URL_LIST)}) THEN 'block' ELSE 'allow' END AS verdict
        FROM u""",
    "op5_minhash_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) END AS sh FROM w),
        e AS (SELECT doc_id, unnest(sh) AS h FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
        r AS (SELECT doc_id AS node, doc_id AS comp FROM documents UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.node),
        c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, comp AS component_id, doc_id = comp AS kept FROM s JOIN c ON node = doc_id""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
        r AS (SELECT vec_id AS node, vec_id AS comp FROM v UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.node),
        c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node),
        d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(d.n, 0) AS n_links, comp AS component_id, vec_id = comp AS kept
        FROM v JOIN c ON node = vec_id LEFT JOIN d ON d.a = vec_id""",
    "op9_source_mixing": r"""
        WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight, 2 * source_size AS most FROM t),
        o AS (SELECT *, coalesce(CAST(sum(most) OVER p AS BIGINT), 0) AS fixed, CAST(sum(weight) OVER q AS BIGINT) AS free, row_number() OVER (ORDER BY most / weight, source) AS k,
            CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w
          WINDOW p AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 q AS (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        g AS (SELECT arg_min((CAST(1.5 AS DOUBLE) * total - fixed) / free, k) AS level FROM o WHERE weight * ((CAST(1.5 AS DOUBLE) * total - fixed) / free) <= most),
        x AS (SELECT source, source_size, least(weight * coalesce(level, 0.0), CAST(most AS DOUBLE)) AS target FROM w LEFT JOIN g ON true),
        y AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
            CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS draw
          FROM s JOIN x ON s.source IS NOT DISTINCT FROM x.source)
        SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM y""",
}
