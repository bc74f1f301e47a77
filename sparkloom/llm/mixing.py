"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id; a source keeps the documents whose hash is at or below its threshold, so a
smaller budget's documents are always among a larger one's. Thresholds come from three histograms of token sums: the
first 16 bits of the hash for all documents, then the next 22 bits for the one bucket in which a budget ends, then the
last 22. Documents are never sorted; they are counted, then filtered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import doc_hash, fresh, word_count, written

#: Widths, in bits, of the three histograms.
LEVELS = (16, 22, 22)


def thresholds(narrow: DataFrame, weights: Mapping[str, float] | None, fractions: Sequence[float]) -> DataFrame:
    """(source, level, cut): the highest hash that source keeps at each nested budget; -1 where nothing fits.

    ``narrow`` has source, h and tokens. The largest budget is the most that the weights allow without repeating a
    document; ``fractions`` of it are the nested ones. Without ``weights`` a source weighs the square root of its tokens.
    """
    totals = narrow.groupBy("source").agg(F.sum("tokens").alias("n")).filter("n > 0")
    if weights is None:
        totals = totals.withColumn("w", F.sqrt(F.col("n").cast("double")))
    else:
        given = narrow.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "source2 string, w double")
        totals = totals.join(given, totals["source"].eqNullSafe(given["source2"])).drop("source2")
    most = totals.agg(F.min(F.col("n") / F.col("w")).alias("most"))
    levels = narrow.sparkSession.createDataFrame([(i, float(f)) for i, f in enumerate(fractions)], "level int, fraction double")
    budgets = (
        totals.crossJoin(most)
        .crossJoin(levels)
        .select("source", "level", F.floor(F.col("w") * F.col("most") * F.col("fraction") + 1e-6).cast("long").alias("budget"))
    )
    # State of a search: budget tokens are sought; below `low` hashes are all kept and weigh `base`.
    state = written(budgets.select("source", "level", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"), F.lit(False).alias("done"), F.lit(-1).cast("long").alias("cut")))
    shift = common.HASH_BITS
    for width in LEVELS:
        shift -= width
        size = 1 << shift
        if width == LEVELS[0]:
            hist = narrow.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("t"))
            at = state.alias("s").join(hist.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")))
        else:
            # Only documents in a boundary bucket are counted again.
            edge = state.filter(~F.col("done")).select("source", "prefix").distinct()
            part = narrow.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright(F.col("d.h"), shift + width) == F.col("e.prefix")))
            hist = part.groupBy(F.col("d.source").alias("source"), F.shiftright(F.col("d.h"), shift).alias("bucket")).agg(F.sum("tokens").alias("t"))
            at = state.filter(~F.col("done")).alias("s").join(
                hist.alias("b"),
                F.col("s.source").eqNullSafe(F.col("b.source")) & (F.shiftright(F.col("b.bucket"), width) == F.col("s.prefix")),
            )
        w = Window.partitionBy("s.source", "s.level").orderBy("b.bucket")
        run = at.select("s.source", "s.level", "s.budget", "b.bucket", "b.t", (F.col("s.base") + F.sum("b.t").over(w)).alias("cum"))
        over = F.col("cum") > F.col("budget")
        ends = run.groupBy("source", "level", "budget").agg(
            F.min(F.when(over, F.col("bucket"))).alias("edge"),
            F.max(F.when(~over, F.col("cum"))).alias("under"),
        )
        done_now = F.col("edge").isNull()  # everything counted fits
        step = ends.alias("n").join(state.filter(~F.col("done")).alias("o"), F.col("n.source").eqNullSafe(F.col("o.source")) & (F.col("n.level") == F.col("o.level")))
        step = step.select(
            "o.source", "o.level", "o.budget",
            F.coalesce(F.col("n.edge"), F.lit(0).cast("long")).alias("prefix"),
            F.coalesce(F.col("n.under"), F.col("o.base")).alias("base"),
            (done_now | F.lit(shift == 0)).alias("done"),
            F.when(done_now, F.lit((1 << common.HASH_BITS) - 1)).otherwise(F.col("n.edge") * F.lit(size) - 1).cast("long").alias("cut"),
        )
        state = written(step.unionByName(state.filter("done")))
    return state.select("source", "level", "cut")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    fractions: Sequence[float] = (1.0,),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    level_col: str = "budget_level",
    tokens_col: str = "n_tokens",
    tokens: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """The documents that the largest budget keeps, with their token count and the smallest nested budget that has them.

    A source keeps, in order of the hash of the id, as many documents as its budget holds; documents of one hash (repeated
    rows of an id) are kept or dropped together. A null source is a source of its own; a null id hashes as ''. Documents
    without tokens (null or empty text) weigh nothing and stay if their hash is below the cut; a source that has only
    such documents has no budget and is dropped, as is one without a weight. An empty table gives an empty one. Columns
    of other names pass through; should the table have ``level_col`` or ``tokens_col`` already, underscores go before ours.
    """
    level, count, h, cuts, of = (fresh(docs.columns, x) for x in (level_col, tokens_col, "_mix_h", "_mix_cuts", "_mix_source"))
    narrow = written(docs.select(F.col(source_col).cast("string").alias("source"), doc_hash(F.col(id_col)).alias("h"), tokens(F.col(text_col)).alias("tokens")))
    cut = thresholds(narrow, weights, sorted(fractions))
    per = cut.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", "cut"))).alias(cuts)).withColumnRenamed("source", of)
    kept = docs.withColumn(h, doc_hash(F.col(id_col))).join(per, F.col(source_col).cast("string").eqNullSafe(F.col(of)))
    first = F.filter(F.col(cuts), lambda x: F.col(h) <= x["cut"])
    return (
        kept.filter(F.col(h) <= F.element_at(F.col(cuts), -1)["cut"])
        .withColumn(level, F.element_at(first, 1)["level"])
        .withColumn(count, tokens(F.col(text_col)))
        .drop(h, cuts, of)
    )


#: Nested budgets of the registered query, as shares of the largest.
FRACTIONS = (0.1, 0.5, 1.0)


def op6(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"), fractions=FRACTIONS).select("doc_id", "source", "n_tokens", "budget_level")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, {common.DOC_HASH_SQL} AS h, {common.WORDS_SQL} AS n_tokens FROM documents),
n AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM d GROUP BY source HAVING sum(n_tokens) > 0),
m AS (SELECT min(n::DOUBLE / sqrt(n::DOUBLE)) AS most FROM n),
c AS (SELECT d.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum FROM d),
b AS (SELECT c.doc_id, c.source, c.n_tokens, cum, sqrt(n.n::DOUBLE) * m.most AS budget
      FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source CROSS JOIN m)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(CASE WHEN cum <= floor(budget * 0.1 + 1e-6) THEN 0 WHEN cum <= floor(budget * 0.5 + 1e-6) THEN 1 ELSE 2 END AS INTEGER) AS budget_level
FROM b WHERE cum <= floor(budget * 1.0 + 1e-6)
"""
