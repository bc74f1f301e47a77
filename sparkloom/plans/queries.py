"""The registered queries of the library's own operators, and the SQL each must equal.

Cosines and distances are rounded to six places, so that the last bits of floating-point sums don't matter.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, inference, messages, vectors
from ..functions.accessor import ai
from ..operators.ann import knn_approx
from ..operators.knn import gather, knn_join, knn_positions
from ..sources.providers import Mock
from ..sources.tables import table

K = 5
RANKS = os.environ.get("SPARKLOOM_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
TAXONOMY = {
    "length": {"description": "How long the document is.", "values": {"short": "Under 1,000 characters.", "long": "1,000 characters or more."}},
    "language": {"description": "What it is written in.", "values": {"plain": "No letter with an accent.", "accented": "Letters with accents."}},
}


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every vector beside the one of the next id."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_A, _B = "a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]"


def cosine_pairs(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(vectors.cosine_similarity("v", "w"), 6).alias("cosine"))


def dot_pairs(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(vectors.dot_product("v", "w"), 6).alias("dot"))


def distance_pairs(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(ai("v").euclidean_distance("w"), 6).alias("distance"))


def _knn(df: DataFrame) -> DataFrame:
    return knn_join(df, df, K, query_id="vec_id", query_vector="embedding", corpus_id="vec_id", corpus_vector="embedding", exclude_same_id=True)


def knn_topk(spark, d):
    return _knn(table(spark, d, "embeddings")).select(F.col("query_id").alias("vec_id"), F.col("neighbor_id"), F.col("rank"), F.round("distance", 6).alias("distance"))


def knn_full_probe(spark, d):
    """The index searched through all its cells: as exact as ``knn_topk``."""
    e = table(spark, d, "embeddings")
    found = knn_approx(e, e, K, cells=16, probes=16, query_id="vec_id", query_vector="embedding", corpus_id="vec_id", corpus_vector="embedding", exclude_same_id=True)
    return found.select(F.col("query_id").alias("vec_id"), F.col("neighbor_id"), F.col("rank"), F.round("distance", 6).alias("distance"))


def knn_index(spark, d):
    """The index searched through as many cells as its sample asks for; compared with the exact search in the tests."""
    e = table(spark, d, "embeddings")
    return knn_approx(e, e, K, query_id="vec_id", query_vector="embedding", corpus_id="vec_id", corpus_vector="embedding", exclude_same_id=True).select(F.col("query_id").alias("vec_id"), "neighbor_id", "rank", "distance")


def semantic_search(spark, d):
    """For every vector whose id 50 divides, the three most similar English documents, which have the vectors of their ids."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    corpus = docs.filter("lang = 'en'").join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", "embedding", "source")
    found = knn_join(e.filter("vec_id % 50 = 0"), corpus, 3, query_id="vec_id", corpus_id="doc_id")
    return gather(corpus.select("doc_id", "source"), found, id_col="doc_id").select(F.col("query_id").alias("vec_id"), "doc_id", "source", F.col("rank"), F.round(1 - F.col("distance"), 6).alias("similarity"))


def row_slice(spark, d):
    """Rows 10 to 29 in the order of ids."""
    return table(spark, d, "embeddings").select("vec_id", "label").orderBy("vec_id").offset(10).limit(20)


def filtered_knn(spark, d):
    df = table(spark, d, "embeddings").filter("label = 3")
    return _knn(df).select(F.col("query_id").alias("vec_id"), "neighbor_id", "rank")


def knn_gather(spark, d):
    """The labels of every vector's neighbours: how many agree with its own."""
    df = table(spark, d, "embeddings")
    found = gather(df.select("vec_id", F.col("label").alias("theirs")), _knn(df), id_col="vec_id").select("query_id", "theirs")
    own = df.select(F.col("vec_id").alias("query_id"), "label")
    return found.join(own, "query_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("theirs") == F.col("label")).alias("agree"))


_KNN_SQL = """
SELECT a.vec_id, b.vec_id AS neighbor_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, a.label AS label, b.label AS theirs,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
FROM {t} a JOIN {t} b ON a.vec_id <> b.vec_id QUALIFY rank <= 5
"""


def knn_cells(spark, d):
    """Of the vectors of the next four ids, in one cell, the places of the three nearest."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = e.select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).withColumn("other", F.col("vec_id") + F.col("i")).join(e.select(F.col("vec_id").alias("other"), F.col("v").alias("w")), "other", "left")
    # Sorted by place, with nulls where an id is missing.
    cells = near.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("cell"))
    return e.join(cells, "vec_id").select("vec_id", F.posexplode(knn_positions("v", "cell", k=3)).alias("rank", "position"))


def centroids(spark, d):
    """Every vector's distance to its label's centre."""
    df = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = df.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    middle = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return df.join(middle, "label").select("vec_id", "label", F.round(vectors.euclidean_distance("v", "c"), 6).alias("distance"))


def label_matrix(spark, d):
    """Cosines between the first vectors of all labels: a cross join of as many rows as labels."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return e.crossJoin(e.select(F.col("label").alias("other"), F.col("v").alias("w"))).select("label", "other", F.round(vectors.cosine_similarity("v", "w"), 6).alias("cosine"))


def label_counts(spark, d):
    e = table(spark, d, "embeddings")
    ids = F.sort_array(F.collect_list("vec_id"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("vec_id"), 6).alias("mean_id"), F.count_if(F.col("embedding").isNull()).alias("nulls"), F.size(ids).alias("n_ids"), F.element_at(ids, 1).alias("first_id"))


def to_message(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", messages.string_to_message("text", message_type="user").alias("message"))


def combine(spark, d):
    c = table(spark, d, "conversations")
    system = F.when(F.col("turn") % 2 == 0, messages.string_to_message(F.lit("Be brief."), message_type="system"))
    return c.select("conv_id", "turn", messages.combine_messages(system, messages.string_to_message("text"), F.lit("[]"), F.lit("42")).alias("messages"))


def conversation(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(messages.conversation("turn", "role", "text").alias("messages"))


def template(spark, d):
    return table(spark, d, "documents").select("doc_id", messages.template("{} ({lang}): {{{n}}}", "source", lang="lang", n="n_chars").alias("prompt"))


def char_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))


def mock_inference(spark, d):
    return table(spark, d, "benchmark").select("item_id", inference.inference("text", client=Mock()).alias("answer"))


def mock_inference_async(spark, d):
    return table(spark, d, "documents").select("doc_id", inference.inference_async("text", client=Mock()).alias("answer"))


def mock_messages(spark, d):
    """The answer to every conversation: the mock repeats its last message."""
    return conversation(spark, d).select("conv_id", inference.inference_messages("messages", client=Mock()).alias("answer"))


def _structured(sent, schema):
    text = sent[-1]["content"]
    n = len(text)
    return json.dumps({"n": n, "first": text[:1], "long": n >= 1000} if n % 7 else {"n": "many"})


_SCHEMA = {
    "title": "Facts", "type": "object", "required": ["n", "first", "long"],
    "properties": {"n": {"type": "integer"}, "first": {"type": "string"}, "long": {"type": "boolean"}},
}


def structured(spark, d):
    """Answers by a schema; every seventh length gives one that breaks it."""
    x = table(spark, d, "documents").select("doc_id", inference.inference_async("text", client=Mock(answer=_structured), response_model=_SCHEMA).alias("r"))
    return x.select("doc_id", "r.n", "r.first", "r.long", F.col("r._error").alias("error"))


def _tags(sent, schema):
    text = sent[-1]["content"]
    chosen = {"length": "long" if len(text) >= 1000 else "short", "language": "plain" if text.isascii() else "accented"}
    return json.dumps({f: {"thinking": {v: "as told"}, "reflection": "by rule", "value": v, "confidence": (len(text) % 100) / 100} for f, v in chosen.items()})


def taxonomy(spark, d):
    x = table(spark, d, "documents").select("doc_id", inference.tag_taxonomy("text", TAXONOMY, client=Mock(answer=_tags)).alias("t"))
    fields = ("doc_id", F.col("t.length.value").alias("length"), F.col("t.language.value").alias("language"), F.col("t.length.thinking").alias("thinking"), "t.length.confidence", F.col("t._error").alias("error"))
    return x.select(*fields).filter(F.col("confidence") > 0.5)


def _bytes(text):
    raw = text.encode()
    return [float(len(raw)), float(raw[0]) if raw else 0.0, float(raw[-1]) if raw else 0.0]


def mock_embedding(spark, d):
    x = table(spark, d, "documents").select("doc_id", inference.embedding("text", client=Mock(vector=_bytes)).alias("e"))
    return x.select("doc_id", F.element_at("e", 1).alias("n_bytes"), F.size("e").alias("dims"))


def cost_tokens(spark, d):
    c = table(spark, d, "documents").select("doc_id", cost.cost_from_tokens("n_chars", model="gpt-4o").alias("usd"), cost.cost_from_tokens("n_chars", provider="anthropic", model="claude-3-haiku-20240307", output=True).alias("usd_out"), cost.cost_from_tokens("n_chars", model="unpriced").alias("none"))
    return c.select("doc_id", F.round("usd", 12).alias("usd"), F.round("usd_out", 12).alias("usd_out"), "none")


def count_tokens(spark, d):
    count = cost.count_tokens("text", tokenizer=cost.rank_tokenizer(RANKS))
    return table(spark, d, "documents").select("doc_id", count.alias("n_tokens"))


def input_cost(spark, d):
    usd = cost.input_cost("text", model="gpt-4o", tokenizer=cost.rank_tokenizer(RANKS))
    return table(spark, d, "documents").select("doc_id", usd.alias("usd"))


def top_documents(spark, d):
    """The ten longest documents that have a label, with it."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "n_chars", "quality").orderBy(F.desc("n_chars"), "doc_id").limit(10)


def filtered_tags(spark, d):
    """Documents by language and label."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").filter((F.col("lang") == "en") & ((F.col("quality") == 1) | (F.col("toxic") > 0)) & F.col("text").isNotNull())
    return j.groupBy("source", "quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        cosine_pairs, dot_pairs, distance_pairs, knn_topk, knn_full_probe, knn_index, semantic_search, row_slice, filtered_knn, knn_gather, knn_cells, centroids, label_matrix, label_counts, to_message, combine, conversation,
        template, char_length, mock_inference, mock_inference_async, mock_messages, structured, taxonomy, mock_embedding, cost_tokens, count_tokens, input_cost, top_documents, filtered_tags,
    )
}

_USER = "'" + json.dumps({"role": "user"})[:-1] + ", " + json.dumps("content") + ": ' || to_json(text) || '}'"
_TURN = "'{\"role\": ' || to_json(role) || ', \"content\": ' || to_json(text) || '}'"
ORACLE_SQL = {
    "cosine_pairs": f"SELECT a.vec_id, round(list_cosine_similarity({_A}, {_B}), 6) AS cosine {_NEXT}",
    "dot_pairs": f"SELECT a.vec_id, round(list_inner_product({_A}, {_B}), 6) AS dot {_NEXT}",
    "distance_pairs": f"SELECT a.vec_id, round(list_distance({_A}, {_B}), 6) AS distance {_NEXT}",
    "knn_topk": f"SELECT vec_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(1 - round(s, 9), 6) AS distance FROM ({_KNN_SQL.format(t='embeddings')})",
    "knn_full_probe": f"SELECT vec_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(1 - round(s, 9), 6) AS distance FROM ({_KNN_SQL.format(t='embeddings')})",
    "semantic_search": """
        WITH s AS (SELECT a.vec_id, doc_id, source, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
                   FROM embeddings a, embeddings b JOIN documents d ON d.doc_id = b.vec_id WHERE lang = 'en' AND a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, doc_id) AS rank FROM s)
        SELECT vec_id, doc_id, source, CAST(rank AS INTEGER) AS rank, round(1 - (1 - s), 6) AS similarity FROM r WHERE rank <= 3""",
    "row_slice": "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 20 OFFSET 10",
    "filtered_knn": f"SELECT vec_id, neighbor_id, CAST(rank AS INTEGER) AS rank FROM ({_KNN_SQL.format(t='(SELECT * FROM embeddings WHERE label = 3)')})",
    "knn_gather": f"SELECT label, count(*) AS n, count(*) FILTER (theirs = label) AS agree FROM ({_KNN_SQL.format(t='embeddings')}) GROUP BY label",
    "knn_cells": """
        WITH s AS (SELECT a.vec_id, b.vec_id - a.vec_id - 1 AS position, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
                   FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 4),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, position) - 1 AS rank FROM s)
        SELECT vec_id, CAST(rank AS INTEGER) AS rank, position FROM r WHERE rank < 3""",
    "centroids": """
        WITH p AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT label, i, avg(x) AS c FROM p GROUP BY label, i)
        SELECT vec_id, p.label, round(sqrt(sum((x - c) * (x - c))), 6) AS distance FROM p JOIN m ON p.label = m.label AND p.i = m.i GROUP BY vec_id, p.label""",
    "label_matrix": """
        WITH e AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label)
        SELECT a.label, b.label AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a CROSS JOIN e b""",
    "label_counts": "SELECT label, count(*) AS n, round(avg(vec_id), 6) AS mean_id, count(*) FILTER (embedding IS NULL) AS nulls, CAST(len(list(vec_id)) AS INTEGER) AS n_ids, min(vec_id) AS first_id FROM embeddings GROUP BY label",
    "to_message": f"SELECT conv_id, turn, {_USER} AS message FROM conversations",
    "combine": f"SELECT conv_id, turn, '[' || CASE WHEN turn % 2 = 0 THEN '{{\"role\": \"system\", \"content\": \"Be brief.\"}},' ELSE '' END || {_USER} || ',42]' AS messages FROM conversations",
    "conversation": f"SELECT conv_id, '[' || string_agg({_TURN}, ',' ORDER BY turn) || ']' AS messages FROM conversations GROUP BY conv_id",
    "template": "SELECT doc_id, source || ' (' || lang || '): {' || n_chars || '}' AS prompt FROM documents",
    "char_length": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents",
    "mock_inference": "SELECT item_id, 'Answer to: ' || text AS answer FROM benchmark",
    "mock_inference_async": "SELECT doc_id, 'Answer to: ' || text AS answer FROM documents",
    "mock_messages": "SELECT conv_id, 'Answer to: ' || arg_max(text, turn) AS answer FROM conversations GROUP BY conv_id",
    "structured": """
        SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN CAST(length(text) AS BIGINT) END AS n, CASE WHEN length(text) % 7 <> 0 THEN substr(text, 1, 1) END AS first,
               CASE WHEN length(text) % 7 <> 0 THEN length(text) >= 1000 END AS long, CASE WHEN length(text) % 7 = 0 THEN 'validation_failed' END AS error FROM documents""",
    "taxonomy": r"""
        WITH t AS (SELECT doc_id, CASE WHEN length(text) >= 1000 THEN 'long' ELSE 'short' END AS length, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'accented' ELSE 'plain' END AS language,
                          (length(text) % 100) / 100 AS confidence FROM documents)
        SELECT doc_id, length, language, '{"' || length || '":"as told"}' AS thinking, confidence, CAST(NULL AS VARCHAR) AS error FROM t WHERE confidence > 0.5""",
    "mock_embedding": "SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS n_bytes, 3 AS dims FROM documents",
    "cost_tokens": "SELECT doc_id, round(n_chars / 1e6 * 2.5, 12) AS usd, round(n_chars / 1e6 * 1.25, 12) AS usd_out, CAST(NULL AS DOUBLE) AS none FROM documents",
    "top_documents": "SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT 10",
    "filtered_tags": """
        SELECT source, quality, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id)
        WHERE lang = 'en' AND (quality = 1 OR toxic > 0) AND text IS NOT NULL GROUP BY source, quality""",
}
