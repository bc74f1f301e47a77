"""Mixture-controlled packing: deficit round-robin over source queues, by prefix sums.

In a round every source gets a quantum of tokens, its share of one window, and sends the documents that its quantum and
its carried deficit pay for. As a queue never idles before its end, a document leaves in the first round whose summed
quanta reach the queue's tokens up to and including it: ``round = (tokens up to it - 1) div quantum``, in the quantum's unit. So a deficit is
never kept anywhere; it is what a prefix sum says, and it carries over windows and partitions exactly. Laid out by round,
then source, the documents form one stream, cut into full windows; a window's mixture differs from the target by less
than one document of each source. When a source is empty the others go on in their proportions.

Prefix sums are made in two steps, sums of ranges and then rows within a range. Ranges are of about equally many rows,
whatever the weights, the sources' sizes and the ids: bounds are found by Spark's sampling, over keys made unique, so that
no task holds a whole source, the whole stream, or all rows of one id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import doc_hash, word_count, written

#: Quanta are kept in sixteenths of a token.
UNIT = 16


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written with ``part``, the number of its range in this order (nulls first); ranges have about equally many rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def stream(docs: DataFrame, window_tokens: int, weights: Mapping[str, float] | None, *, id_col: str, text_col: str, source_col: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, source, tokens, upto, round, part): documents with the round in which they leave, in ranges of the stream."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), doc_hash(F.col(id_col)).alias("h"), tokens(F.col(text_col)).alias("tokens")).filter("tokens > 0")
    queue = _ranges(written(narrow.withColumn("seq", F.monotonically_increasing_id())), "source", "h", "doc_id", "tokens", "seq")
    # A row for each range and for each source in it.
    sums = queue.groupBy("source", "part").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s2"), F.col("part").alias("p2"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    if weights is None:
        totals = sums.groupBy("source").agg(F.sum("t").alias("n"))
        quanta = totals.crossJoin(totals.agg(F.sum("n").alias("all"))).select(F.col("source").alias("s3"), F.greatest(F.lit(1), F.expr(f"({UNIT * window_tokens}L * n) div all")).cast("long").alias("q"))
    else:
        total = sum(v for v in weights.values() if v > 0)
        quanta = docs.sparkSession.createDataFrame([(k, max(1, round(UNIT * window_tokens * v / total))) for k, v in weights.items() if v > 0], "s3 string, q long")
    base = base.join(quanta, F.col("s2").eqNullSafe(F.col("s3"))).drop("s3")
    run = Window.partitionBy("source", "part").orderBy("h", "doc_id", "tokens", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        queue.withColumn("within", F.sum("tokens").over(run))
        .join(base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
        .select("doc_id", "source", "tokens", (F.col("base") + F.col("within")).alias("upto"), "q")
        .select("doc_id", "source", "tokens", "upto", F.expr(f"(upto * {UNIT}L - 1) div q").alias("round"))
    )
    return _ranges(written(ranked), "round", "source", "upto")


def pack(
    docs: DataFrame,
    window_tokens: int = 4096,
    weights: Mapping[str, float] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokens: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """(window_id, window_pos, doc_id, source, doc_start, n_tokens): the pieces that fill windows of ``window_tokens``.

    A piece is ``n_tokens`` tokens of a document from its token ``doc_start`` on, at token ``window_pos`` of the window.
    All windows but the last are full; only documents at a window's edge, or longer than one, are in several pieces.
    ``weights`` are the target proportions by source (others get no token and are left out); without them the target is
    each source's share of all tokens, so that all queues empty together.

    A queue is ordered by the hash of the id, then id, then length. A null source is a queue of its own; a null id is
    packed like any other; documents without tokens (null or empty) give no piece; long texts are counted whole and
    give several; repeated rows are packed each. An empty table gives no rows; columns other than the three named are
    ignored, whatever their names.
    """
    if window_tokens < 1:
        raise ValueError("window_tokens must be positive")
    staged = stream(docs, window_tokens, weights, id_col=id_col, text_col=text_col, source_col=source_col, tokens=tokens)
    parts = staged.groupBy("part").agg(F.sum("tokens").alias("t"))
    # A row for each range: as many as there are shuffle partitions.
    starts = parts.select(F.col("part").alias("p2"), F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    flow = Window.partitionBy("part").orderBy("round", "source", "upto").rowsBetween(Window.unboundedPreceding, 0)
    placed = staged.withColumn("run", F.sum("tokens").over(flow)).join(F.broadcast(starts), F.col("part") == F.col("p2")).withColumn("g", F.col("start") + F.col("run") - F.col("tokens"))
    w = window_tokens
    pieces = placed.select("doc_id", "source", "tokens", "g", F.explode(F.expr(f"sequence(g div {w}L, (g + tokens - 1) div {w}L)")).alias("window_id"))
    lo = F.greatest(F.col("g"), F.col("window_id") * w)
    hi = F.least(F.col("g") + F.col("tokens"), (F.col("window_id") + 1) * w)
    return pieces.select("window_id", (lo - F.col("window_id") * w).alias("window_pos"), "doc_id", "source", (lo - F.col("g")).alias("doc_start"), (hi - lo).alias("n_tokens"))


WINDOW_TOKENS = 4096


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), WINDOW_TOKENS)


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, {common.DOC_HASH_SQL} AS h, CAST({common.WORDS_SQL} AS BIGINT) AS tokens FROM documents),
q AS (SELECT *, sum(tokens) OVER (PARTITION BY source)::BIGINT AS n, sum(tokens) OVER ()::BIGINT AS total,
             sum(tokens) OVER (PARTITION BY source ORDER BY h, doc_id, tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d WHERE tokens > 0),
r AS (SELECT *, (upto * {UNIT} - 1) // greatest(1, ({UNIT * WINDOW_TOKENS} * n) // total) AS round FROM q),
g AS (SELECT *, (sum(tokens) OVER (ORDER BY round, source NULLS FIRST, upto, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - tokens AS g FROM r),
p AS (SELECT doc_id, source, tokens, g, unnest(generate_series(g // {WINDOW_TOKENS}, (g + tokens - 1) // {WINDOW_TOKENS})) AS window_id FROM g)
SELECT window_id, greatest(g, window_id * {WINDOW_TOKENS}) - window_id * {WINDOW_TOKENS} AS window_pos, doc_id, source,
       greatest(g, window_id * {WINDOW_TOKENS}) - g AS doc_start,
       least(g + tokens, (window_id + 1) * {WINDOW_TOKENS}) - greatest(g, window_id * {WINDOW_TOKENS}) AS n_tokens
FROM p
"""
