"""Line dedup by content-defined chunks of lines.

Lines are hashed, a rolling hash runs over the last lines' hashes, and a chunk ends where its low bits are nought: so
the same run of lines is cut at the same places whatever stands before it. A long line is a chunk of its own for the same
reason. Besides the chunks, the least runs of 50 words from and up to every line are pieces, so that a repeated passage goes
whole, wherever the chunks are cut. Pieces that occur again anywhere are joined to runs, which are compared byte for byte;
the first occurrence (lowest id, then lowest place) stays and the others are taken out.

Only hashes are shuffled to find the repeats; texts are shuffled once, to meet their runs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import fresh, join_hot, per_batch, written

#: Lines that the rolling hash covers, low bits that must be nought at a chunk's end, fewest lines of a cut.
ROLL, MASK, MIN_LINES = 2, 1, 2
#: A line of so many words is a chunk of its own.
LONG_LINE_WORDS = 50
PRIME = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1


def chunks(text: str) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, whether it may be removed) of every chunk of ``text.split('\\n')``."""
    import xxhash

    h64 = xxhash.xxh3_64_intdigest
    out: list[tuple[int, int, bool]] = []
    lines = text.split("\n")
    begin, past = 0, [0] * ROLL
    for i, line in enumerate(lines):
        # Counting blanks is cheap and never less than words less one.
        if line.count(" ") >= LONG_LINE_WORDS - 1 and len(line.split()) >= LONG_LINE_WORDS:
            if begin < i:
                out.append((begin, i, i - begin > 1))
            out.append((i, i + 1, True))
            begin, past = i + 1, [0] * ROLL
            continue
        past = [*past[1:], h64(line.encode("utf-8", "surrogatepass"))]
        roll = 0
        for x in past:
            roll = (roll * PRIME + x) & FULL
        if i + 1 - begin >= MIN_LINES and not (roll >> 32) & MASK:
            out.append((begin, i + 1, True))
            begin = i + 1
    if begin < len(lines):
        out.append((begin, len(lines), len(lines) - begin > 1))
    return out


def pieces(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of every removable chunk and of the least runs of LONG_LINE_WORDS words from and up to every line."""
    out = {(a, z) for a, z, may in chunks(text) if may}
    n = [len(line.split()) for line in text.split("\n")]
    z = total = 0
    for a in range(len(n)):
        while z < len(n) and total < LONG_LINE_WORDS:
            total += n[z]
            z += 1
        if total < LONG_LINE_WORDS:
            break
        out.add((a, z))
        total -= n[a]
    a = total = 0
    for z in range(1, len(n) + 1):
        total += n[z - 1]
        while total - n[a] >= LONG_LINE_WORDS:
            total -= n[a]
            a += 1
        if total >= LONG_LINE_WORDS:
            out.add((a, z))
    return sorted(out)


def occurrences(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, key, a, z, hash) of every piece; key is a hash of the whole text. Pieces of blanks are passed over."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        import xxhash

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            row, first, end, hashed = [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                lines = [x.encode("utf-8", "surrogatepass") for x in t.split("\n")]
                for a, z in pieces(t):
                    c = b"\n".join(lines[a:z])
                    if c and not c.isspace():
                        row.append(r)
                        first.append(a)
                        end.append(z)
                        hashed.append(xxhash.xxh3_64_intdigest(c) - (1 << 63))
            at = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(hashed, pa.int64())], names=["id", "key", "a", "z", "hash"])

        return run

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return per_batch(texts, ["id", "text", "key"], make, f"`id` {kind}, key long, a int, z int, hash long")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", same: DataFrame | None = None) -> DataFrame:
    """(id, key, a, z, late): runs of lines that by their pieces' hashes stand earlier (late), and the earlier runs they are taken for."""
    found = occurrences(docs, id_col=id_col, text_col=text_col).withColumn("grp", F.lit(None).cast("long"))
    if same is not None:
        found = found.drop("grp").join(same.select(F.col("id").alias("_id"), F.col("grp")), F.col("id") == F.col("_id"), "left").drop("_id")
    found = written(found)
    first = written(found.groupBy("hash").agg(F.min(F.struct("id", "key", "a", "grp")).alias("o"), F.min(F.struct("id", "key", "a", F.lit(0))).alias("lo"), F.max(F.struct("id", "key", "a", F.lit(0))).alias("hi"), F.count("*").alias("n")).filter("lo <> hi").drop("lo", "hi"))
    both = join_hot(found, first, "hash", found.count())
    own, its = (F.struct(*(F.col(p + c).alias(c) for c in ("id", "key"))) for p in ("", "o."))
    another = ~own.eqNullSafe(its)
    later = both.filter((another & ~F.coalesce(F.col("grp") == F.col("o.grp"), F.lit(False))) | (~another & (F.col("a") > F.col("o.a"))))
    later = later.select("id", "key", "a", "z", F.col("o.id").alias("oid"), F.col("o.key").alias("okey"), (F.col("a") - F.col("o.a")).alias("shift"))
    # Pieces that lie at one distance from their first places are joined where they touch.
    same_shift = Window.partitionBy("id", "key", "oid", "okey", "shift").orderBy("a", "z")
    reach = F.max("z").over(same_shift.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("part", F.sum("new").over(same_shift.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(islands.groupBy("id", "key", "oid", "okey", "shift", "part").agg(F.min("a").alias("a"), F.max("z").alias("z")))
    late = runs.select("id", "key", "a", "z", F.lit(True).alias("late"))
    early = runs.select(F.col("oid").alias("id"), F.col("okey").alias("key"), (F.col("a") - F.col("shift")).alias("a"), (F.col("z") - F.col("shift")).alias("z"), F.lit(False).alias("late"))
    return late.unionByName(early)


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", same: DataFrame | None = None) -> DataFrame:
    """``docs`` without the pieces (chunks, and runs of LONG_LINE_WORDS words or more) that stand earlier; documents of which nothing but blanks is left are dropped.

    The first occurrence of a piece stays: that of the lowest id (null is lowest), then text's hash, then place, also
    within one document. Pieces are compared byte for byte; of every line that goes an earlier copy stays. ``same`` (id,
    grp) names documents that are versions of one: a piece that first stands in a version isn't taken out of the others.
    Without it, every document is by itself.

    Null and empty texts stay as they are; texts of any length are read whole. Rows of one id and one text are one
    document, so they fare alike, and rows of one id (or null) with different texts are documents each. If the table has
    ``count_col``, it is the number of characters of a text that was cut. Other columns pass through, whatever their
    names. Short single lines are never removed, however often they occur. An empty table gives an empty one.
    """
    key, spans = (fresh(docs.columns, x) for x in ("_line_key", "_line_spans"))
    of_id, of_key = (fresh([*docs.columns, key, spans], x) for x in ("_line_of", "_line_of_key"))
    runs = repeats(docs, id_col=id_col, text_col=text_col, same=same)
    wanted = runs.groupBy(F.col("id").alias(of_id), F.col("key").alias(of_key)).agg(F.collect_set(F.struct("a", "z", "late")).alias(spans))
    # The only shuffle of texts. Rows a document aren't broadcast, however few they are.
    held = docs.withColumn(key, F.xxhash64(text_col)).join(wanted.hint("merge"), F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left").drop(of_id, of_key)
    held = written(held)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            row, first, end, late, body = [], [], [], [], []
            each = b.column(3).to_pylist()
            for r, t in enumerate(b.column(1).to_pylist()):
                lines = t.split("\n")
                for s in each[r]:
                    row.append(r)
                    first.append(s["a"])
                    end.append(s["z"])
                    late.append(s["late"])
                    body.append("\n".join(lines[s["a"] : s["z"]]).encode("utf-8", "surrogatepass"))
            at = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(late, pa.bool_()), pa.array(body, pa.binary())], names=["id", "key", "a", "z", "late", "body"])

        return run

    texts = held.filter(F.col(spans).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(key).alias("key"), F.col(spans).alias("spans"))
    bodies = per_batch(texts, ["id", "text", "key", "spans"], make, f"`id` {kind}, key long, a int, z int, late boolean, body binary")
    # Grouping by the bytes themselves is the comparison. A late run that is the first of its bytes had an equal hash but
    # no equal: it stays. That is as rare as two hashes of 64 bits that collide.
    alone = written(bodies.groupBy(F.xxhash64("body").alias("h"), "body").agg(F.min(F.struct("id", "key", "a", "z", F.expr("not late").alias("early"))).alias("first")).filter("not first.early").select("first.id", "first.key", "first.a", "first.z"))
    if not alone.isEmpty():
        stay = fresh([*docs.columns, key, spans], "_line_stay")
        alone = alone.groupBy(F.col("id").alias(of_id), F.col("key").alias(of_key)).agg(F.collect_set(F.struct("a", "z", F.lit(True).alias("late"))).alias(stay))
        held = held.join(alone, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left")
        held = held.withColumn(spans, F.array_except(spans, F.coalesce(stay, F.array().cast("array<struct<a:int,z:int,late:boolean>>")))).drop(of_id, of_key, stay)
    return _cut(held.drop(key), docs, spans, text_col, count_col)


def _cut(held: DataFrame, docs: DataFrame, spans: str, text_col: str, count_col: str | None) -> DataFrame:
    """``held``, the rows of ``docs`` and the spans of each, less the late ones' lines."""
    at, last = docs.columns.index(text_col), len(docs.columns)
    n_at = docs.columns.index(count_col) if count_col in docs.columns else None

    def run(batches):
        for b in batches:
            texts, drops = b.column(at).to_pylist(), b.column(last).to_pylist()
            keep, changed = [True] * b.num_rows, {}
            for r, each in enumerate(drops):
                gone = {i for s in each or () if s["late"] for i in range(s["a"], s["z"])}
                if gone:
                    changed[r] = "\n".join(line for i, line in enumerate(texts[r].split("\n")) if i not in gone)
                    keep[r] = bool(changed[r].strip())
            cols = [b.column(i) for i in range(last)]
            if changed:
                cols[at] = pa.array([changed.get(r, t) for r, t in enumerate(texts)], b.schema.field(at).type)
                if n_at is not None:
                    n = cols[n_at].to_pylist()
                    cols[n_at] = pa.array([len(changed[r]) if r in changed else n[r] for r in range(b.num_rows)], b.schema.field(n_at).type)
            out = pa.RecordBatch.from_arrays(cols, schema=pa.schema([b.schema.field(i) for i in range(last)]))
            yield out.filter(pa.array(keep, pa.bool_()))

    return held.select(*(F.col(f"`{c}`") for c in [*docs.columns, spans])).mapInArrow(run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """Every document that is left, with its text less the repeated passages."""
    return drop_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")
