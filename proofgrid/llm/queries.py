"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw_dedup, html_wrapper, lang_centroid, lattice_lm, odd_sketch, permutation_index, piece_bpe, pivotal_mix, source_audit, token_alignment, token_transducer, toxicity_gru, url_cascade
from .common import fold_of, read

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, ceiling=2.0)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(read(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_centroid.fit(docs, fold_of("doc_id", 3) != 1)
    held = (fold_of("doc_id", 3) == 1).alias("held_out")
    return lang_centroid.identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.9)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lattice_lm.score(docs, fold_of("doc_id", 7) != 2, vocabulary("piece_bpe_32k.model"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_bpe.encode(docs, vocabulary("piece_bpe_32k.model"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"), least=10, top=10)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity_gru.fit(docs, read(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    held = (fold_of("doc_id", 5) == 0).alias("held_out")
    return toxicity_gru.score(docs.select("doc_id", held, "text"), net).select("doc_id", "held_out", "score", "predicted")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)


QUERIES = {f.__name__: f for f in (op1_permutation_search, op2_url_filter, op3_source_mix, op4_main_text, op5_language, op6_vector_duplicates, op7_lm_score, op8_near_duplicates, op9_token_count, op10_piece_codec, op11_source_audit, op12_toxicity, op13_token_alignment)}

ORACLE_SQL = {
    "op2_url_filter": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), rules(rule, rhost, rpath, rverdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), fits AS (
            SELECT page_id, rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
            FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
        FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.k = 1
    """,
    "op6_vector_duplicates": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, m.c = e.vec_id AS kept
        FROM embeddings e JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = e.vec_id
    """,
    "op8_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        l AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
        r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
    """,
    "op11_source_audit": r"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), t AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
        k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
        c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
        p AS MATERIALIZED (
            SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM c JOIN v USING (lang)
        ), q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN v USING (lang)
        ), s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
