"""Shared helpers: materialised tables in the shared folder, hashes, token counts, column-name care."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost

#: Bits of the document hash that orders and samples documents.
HASH_BITS = 60


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder (tests); a cluster is refused, because a folder of
    one machine would be lost with it.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sparkloom-")
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a lineage cut that survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sparkloom-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def doc_hash(id_col: Column, salt: str = "") -> Column:
    """60 pseudo-random bits of an id, the same in Spark and in SQL engines that have md5. A null id hashes as ''."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(salt)) if salt else F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


DOC_HASH_SQL = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"
WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))"


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def bpe_count(ranks_path: str, pattern: str = cost.SPLIT) -> Callable[[Column], Column]:
    """A token counter by a byte-level BPE vocabulary of ranks (``base64 rank`` lines), for ``tokens=`` parameters.

    The file must be readable at that path on every executor. Null counts 0.
    """
    return lambda c: F.coalesce(cost.count_tokens(c, tokenizer=cost.rank_tokenizer(ranks_path, pattern)), F.lit(0).cast("long"))


def per_batch(df: DataFrame, columns: Iterable[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` of ``columns`` with a function made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                out = f(b)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or it with underscores before it until no column of ``taken`` has it (letter case aside)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


#: A key that one in so many rows has, or more, is hot.
HOT = 1000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``by_key``, which has a row for each key and in ``n`` how many of the ``total`` rows have it.

    Keys that a thousandth of the rows or more have are a thousand at most, so they are broadcast; of the others no key
    is large enough to burden a task. Both tables are read twice, so they should be written ones. ``n`` isn't returned.
    """
    hot = F.broadcast(by_key.filter(F.col("n") * HOT >= total).drop("n"))
    cold = by_key.filter(F.col("n") * HOT < total).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def schema_of(id_col: str, id_kind: str, ours: Mapping[str, str]) -> str:
    """The schema of an id column and of ``ours`` (name: type), which have underscores before them where they are named like the id."""
    return f"`{id_col}` {id_kind}, " + ", ".join(f"`{fresh([id_col], n)}` {k}" for n, k in ours.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
