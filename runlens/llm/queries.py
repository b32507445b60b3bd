"""Queries of this package over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    chat_format, circulant_minhash, conversation_trie, fill_in_middle, graph_neighbours, html_wrapper, mixing, packing, pu_quality, quality_rules,
    suffix_repeats, surrogates, url_filter,
)
from .common import stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


OP2_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]


@query("op2_chat_format", chat_format.digests_sql())
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(chat_format.HOSTILE).alias("text"),
    )
    return chat_format.digests(turns.unionByName(hostile)).select(*OP2_COLUMNS)


@query(
    "op7_quality_rules",
    f"SELECT doc_id, {', '.join(quality_rules.METRICS)}, base_failed, kept FROM ({quality_rules.verdicts_sql()})",
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select("doc_id", *quality_rules.METRICS, "base_failed", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 85 * (nu.n + nv.n - c)),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u AS doc_id, least(u, min(v)) AS low FROM r GROUP BY u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id,
  coalesce(low, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op5_circulant_minhash", OP5_SQL)
def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return circulant_minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY md5(array_to_string(ws[p : p + 34], ' '))) AS c FROM g),
r AS (SELECT DISTINCT rid, p + o AS p FROM h, range(35) t(o) WHERE c > 1),
k AS (SELECT rid, list(p) AS gone FROM r GROUP BY rid),
f AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN ws ELSE
    list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END AS kept
  FROM w LEFT JOIN k USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM f"""


@query("op6_suffix_repeats", OP6_SQL)
def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_source_mixing")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(mixing.sized(table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.taken(*mixing.mix(sizes)).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, with_ids=False)


@query("op8_surrogates")
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get(surrogates.SETTING, "synthetic tables need no secret")
    return surrogates.with_surrogates(docs, key).select("doc_id", "text", "n_replaced")


@query("op4_graph_neighbours")
def op4_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op3_html_wrapper")
def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_wrapper.main_texts(pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op1_pu_quality")
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return pu_quality.quality_scores(docs, labels.select("doc_id", "quality"))[0]


@query("op13_fill_in_middle", fill_in_middle.digests_sql())
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_RULES = url_filter.rules_of(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])


@query("op12_url_filter")
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), OP12_RULES)


@query("op11_conversation_trie", conversation_trie.TRIE_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.shared_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
