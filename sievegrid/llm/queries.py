"""The registered queries of this package, thin callers of its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm import fingerprints, html, language, mixing, neardup, packing, prefixtree, ranked, secrets, tokenization, toxicity, vectors, warc
from sievegrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_order_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_source_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).documents.drop("start", "source")


_OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fine AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM near n WHERE n.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON a = vec_id
"""


@query("op5_multi_index", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_language_fusion")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language.identify(docs, language.fit(docs)).drop("text")


@query("op7_mixture_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_toxicity_pu")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


_OP9_SQL = """
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS hex,
  string_split(regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', ''), '.') AS host,
  regexp_extract(regexp_replace(u, '#.*$', ''), '^[a-z]+://[^/?#]*([^?]*)', 1) AS path,
  regexp_extract(regexp_replace(u, '#.*$', ''), '[?](.*)$', 1) AS query FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to,
  array_to_string(list_reverse(host), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
  make_timestamp((1704067200 + page_id) * 1000000) AS captured_at
FROM k
"""


@query("op9_warc_history", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


@query("op10_merkle_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


_OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tfs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
held AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term),
doc AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(t) * n_docs) // n_terms) AS m FROM d, total WHERE len(t) > 0),
item AS (SELECT item_id, text, term, count(*) AS c FROM (SELECT item_id, text,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, text, term),
scored AS (SELECT item_id, text, rid, any_value(doc_id) AS doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM item JOIN tfs USING (term) JOIN held USING (term) JOIN doc USING (rid) GROUP BY item_id, text, rid),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""


@query("op11_ranked_search", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_OP12_SQL = r"""
WITH orig AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT conv_id, s, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
  4294967295) % 4 AS h FROM orig),
built AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.s, []), 1, h), list_slice(c.s, h + 1, len(c.s))) AS s
  FROM cut c LEFT JOIN orig b ON b.conv_id = c.conv_id - c.conv_id % 20),
pre AS (SELECT conv_id, d, list_slice(s, 1, d) AS p, len(s) = d AS ends, CASE WHEN d > 0 THEN s[d].t ELSE '' END AS said
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
node AS (SELECT d, md5(CAST(p AS VARCHAR)) AS k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n,
  len(regexp_extract_all(any_value(said), '[^ 	-
]+')) AS words,
  sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM pre GROUP BY d, p),
above AS (SELECT k AS of_k, d AS of_d, n AS of_n, words AS of_words, d0, md5(CAST(list_slice(p, 1, d0) AS VARCHAR)) AS k
  FROM (SELECT *, unnest(range(0, d + 1)) AS d0 FROM node)),
kids AS (SELECT d0, k, count(*) FILTER (of_d = d0 + 1) AS n_children FROM above GROUP BY d0, k),
bare AS (SELECT d0, k FROM kids WHERE n_children = 0),
sums AS (SELECT a.d0, a.k, count(*) FILTER (of_d = a.d0 + 1) AS n_children, count(b.k) AS n_leaves, CAST(sum((of_n - 1) * of_words) AS BIGINT) AS saved_tokens
  FROM above a LEFT JOIN bare b ON b.d0 = of_d AND b.k = of_k GROUP BY a.d0, a.k)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN sums s ON s.d0 = n.d AND s.k = n.k
LEFT JOIN node u ON u.d = n.d - 1 AND u.k = md5(CAST(list_slice(n.p, 1, n.d - 1) AS VARCHAR))
"""


@query("op12_prefix_trie", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.prefix_tree(prefixtree.spliced(prefixtree.sequences(table(spark, sf_dir, "conversations"))))


@query("op13_token_automaton")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = tokenization.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return tokenization.digest(tokenization.decode(ids, path))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
