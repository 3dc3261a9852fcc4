"""The contract's queries, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, jaccard, langid, lengths, packing, pii, quality, repair, simhash, tokenbin, trie, urlfilter
from .common import crc_bucket, new_path, remove, settle, table


def op1_learned_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(rows, F.col("vec_id") % 20 == 0, k=20)


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    judged = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), ~held)
    return judged.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_pii_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-blocks")
    tokenbin.write(table(spark, sf_dir, "documents", "doc_id", "text"), folder, end_id=2)
    found = settle(tokenbin.digests(spark, folder), "token-digests")
    remove(spark, folder)  # the digests of its documents are written; the blocks would stay until the session ends
    return found


def op5_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op6_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.marks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op7_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), capacity=2048, end_id=0)


def op8_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    prototypes = langid.train(docs, ~held)
    return langid.predict(docs, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.curve(lengths.histogram(table(spark, sf_dir, "documents", "text")))


def op11_adaptive_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_tensor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.audited(rows, repair.damaged(rows))


def op13_preorder_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trie.turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    rebuilt, convs = trie.grafted(own, F.col("conv_id") - F.col("conv_id") % 5, crc_bucket(F.col("conv_id"), 9))
    return trie.trie(rebuilt, convs)


#: A document's words in DuckDB; its regular expressions want the same class.
_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="text")} AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[s : s + least(len(ws), 13) - 1], ' ') AS phrase
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM documents),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, array_to_string(ws[s : s + n - 1], ' ') AS phrase
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, ns WHERE len(ws) >= n)),
m AS (SELECT r, dw.n, s, item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i : i + 3], ' ') AS sh FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM c JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
m AS (SELECT reach.x, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN m ON m.x = d.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_learned_partition_ann,
        op2_quality_qda,
        op3_pii_transducer,
        op4_pfor_tokens,
        op5_url_logistic,
        op6_positional_decontamination,
        op7_bin_completion_packing,
        op8_simhash_pigeonhole,
        op9_hyperdimensional_langid,
        op10_length_histogram,
        op11_adaptive_prefix_jaccard,
        op12_tensor_repair,
        op13_preorder_trie,
    )
}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_logistic": urlfilter.verdict_sql(), "op6_positional_decontamination": OP6_SQL, "op11_adaptive_prefix_jaccard": OP11_SQL}
