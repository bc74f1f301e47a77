"""Nearest neighbours by cosine distance, exactly.

The DataFrame form packs both sides into pieces of vectors and lays them on a grid: a square joins a row's queries and a
column's part of the corpus, and only the k best of a query in a square are shuffled again. The grid has as many squares as
there are shuffle partitions, or four for each core, and more where a side of a square would be too large to hold; so what is
shuffled grows with the tables. In a square matrix products of 32-bit floats choose what may be among a query's k best so far,
and only that is compared exactly. Nothing is gathered on the driver. The work is the product of both tables' sizes;
``ann.knn_approx`` looks at a part of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import to_col

#: Vectors of a block and bytes of their numbers, whichever comes first; queries of one matrix product, and vectors of the first.
BLOCK, BLOCK_BYTES, QUERY_BLOCK, START = 2048, 32 << 20, 256, 256
#: Rows of either side of a square below which no further squares are made, and bytes of them that one task can hold.
SQUARE_ROWS, SQUARE_BYTES = 8192, 128 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(v: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; a null element counts 0."""
    flat = v.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return flat.reshape(len(v), -1)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of (id, vector) put together until they fill a block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK or sum(8 * len(x.column(1).flatten()) for x in held) >= BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def parts_of(spark, rows: int, n_bytes: int, least_rows: int = SQUARE_ROWS) -> int:
    """Into how many parts a side of the grid is cut."""
    squares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(1, min(math.isqrt(squares - 1) + 1, -(-rows // least_rows)), -(-n_bytes // SQUARE_BYTES))


def rows_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v); rows of a null id or vector are left out."""
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")


#: What a piece has besides its ids: its place, -1 for all; the vectors' length; unit vectors and cells as bytes.
PIECE = "row int, column int, size int, data binary, cells binary"


def piece(ids: pa.Array, row: int, column: int, size: int, data: np.ndarray, cells: np.ndarray | None = None) -> pa.RecordBatch:
    values = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.int32()) for x in (row, column, size))]
    values += [pa.array([x if x is None else x.tobytes()], pa.binary()) for x in (data, cells)]
    return pa.RecordBatch.from_arrays(values, names=["ids", "row", "column", "size", "data", "cells"])


def pieces(rows: DataFrame, parts: int, corpus: bool) -> DataFrame:
    """Unit vectors in pieces, of equally many rows for each row of the grid, or for each column if they are the corpus's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId()
        for b in gathered(batches):
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _unit(_matrix(b.column(1).take(pa.array(at)))) if size else np.zeros((len(at), 0))
                for p in range(min(parts, len(at))):
                    place = (first + p) % parts
                    yield piece(b.column(0).take(pa.array(at[p::parts])), -1 if corpus else place, place if corpus else -1, int(size), x[p::parts])
                first += len(at)

    return rows.mapInArrow(run, f"ids array<{rows.schema['id'].dataType.simpleString()}>, {PIECE}")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 5, *, query_id: str = "id", query_vector: str = "embedding", corpus_id: str = "id", corpus_vector: str = "embedding", exclude_same_id: bool = False) -> DataFrame:
    """(query_id, neighbor_id, rank, distance): for every query the k corpus rows of the least cosine distance.

    Similarities are compared to nine places, ties by the corpus id. Vectors without length are at distance 1 from all.
    Only vectors of one length are compared. Null ids and vectors are left out, k of 0 gives no rows, and a corpus of
    fewer than k gives them all. ``exclude_same_id`` leaves out the row itself when a table is searched in itself. Both
    tables are measured first, for which they are read once more.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    q, c = rows_of(queries, query_id, query_vector), rows_of(corpus, corpus_id, corpus_vector)
    parts = []
    for rows in (q, c):
        n, numbers = rows.agg(F.count("*"), F.sum(F.size("v"))).first()
        parts.append(parts_of(queries.sparkSession, n, 8 * (numbers or 0)))
    return best_of(nearest_on_grid(pieces(q, parts[0], False), pieces(c, parts[1], True), *parts, k, exclude_same_id), k)


class Nearest:
    """The k best of the corpus for each query of a square, both unit vectors of one length; ties by the corpus's ids."""

    def __init__(self, q_ids: pa.Array, x: np.ndarray, c_ids: pa.Array, y: np.ndarray, k: int, exclude_same_id: bool):
        self.q_ids, self.x, self.k, self.exclude = q_ids, x, k, exclude_same_id
        # In order of ids, a place settles a tie.
        nested = pa.types.is_nested(c_ids.type)
        self.order = np.array(sorted(range(len(c_ids)), key=[tuple(v.values()) if isinstance(v, dict) else v for v in c_ids.to_pylist()].__getitem__), np.int64) if nested else pc.sort_indices(c_ids).to_numpy()
        self.c_ids, self.y = c_ids.take(pa.array(self.order)), y[self.order]
        self.x32, self.y32 = x.astype(np.float32), self.y.astype(np.float32)
        #: More than the products of 32-bit floats and the rounding to nine places may be wrong by.
        self.slack = (x.shape[1] + 16) * 2.0**-23 + 2e-9
        self.sim = np.full((len(x), k), -np.inf)
        self.place = np.full((len(x), k), len(y), np.int64)
        self.looked = 0
        if exclude_same_id:
            known: dict = {}
            c_keys, q_keys = ([repr(v) for v in i.to_pylist()] if nested else i.to_pylist() for i in (self.c_ids, q_ids))
            self.c_code = np.array([known.setdefault(v, len(known)) for v in c_keys], np.int64)
            self.q_code = np.array([known.get(v, -1) for v in q_keys], np.int64)

    def compare(self, rows: np.ndarray, places: np.ndarray) -> None:
        """Each of these queries with each of these rows of the corpus, by their places."""
        lo = 0
        while self.k and len(rows) and lo < len(places):
            # Few at first, so that later ones meet a known kth similarity.
            c = places[lo : lo + min(BLOCK, max(START, self.looked))]
            lo, self.looked = lo + len(c), self.looked + len(c)
            y = self.y32[c].T
            held, n_held = [], 0
            for at in range(0, len(rows), QUERY_BLOCK):
                r = rows[at : at + QUERY_BLOCK]
                near = self.x32[r] @ y
                bar = self.sim[r, -1] - self.slack
                new = np.flatnonzero(np.isneginf(bar))
                if len(new):
                    some = near[new]
                    if self.exclude:
                        some[self.q_code[r[new]][:, None] == self.c_code[c][None, :]] = -np.inf
                    some[~np.isfinite(some)] = -np.inf
                    n = min(self.k, len(c))
                    bar[new] = -np.partition(-some, n - 1, axis=1)[:, n - 1] - 2 * self.slack
                i, j = np.divmod(np.flatnonzero(near >= bar.astype(np.float32)[:, None]), len(c))
                held.append((r[i], c[j]))
                n_held += len(i)
                if n_held >= 1 << 16:
                    self._add(held)
                    held, n_held = [], 0
            self._add(held)

    def _add(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if not held:
            return
        query, place = (np.concatenate(v) for v in zip(*held))
        step = max(1, BLOCK_BYTES // (8 * max(1, self.x.shape[1])))
        near = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.x[query[lo : lo + step]], self.y[place[lo : lo + step]]) for lo in range(0, len(query), step))])
        near = np.round(near, 9)
        good = np.isfinite(near) & (near >= self.sim[query, -1])
        if self.exclude:
            good &= self.q_code[query] != self.c_code[place]
        query, place, near = query[good], place[good], near[good]
        if not len(query):
            return
        order = np.lexsort((place, -near, query))
        query, place, near = query[order], place[order], near[order]
        start = np.flatnonzero(np.concatenate([[True], np.diff(query) != 0]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(query))))
        nth = np.arange(len(query)) - start[group]
        good = nth < self.k
        found = query[start]
        sim, at = np.full((len(found), self.k), -np.inf), np.full((len(found), self.k), len(self.y), np.int64)
        sim[group[good], nth[good]], at[group[good], nth[good]] = near[good], place[good]
        sim, at = np.concatenate([self.sim[found], sim], axis=1), np.concatenate([self.place[found], at], axis=1)
        order = np.lexsort((at, -sim), axis=1)[:, : self.k]
        self.sim[found], self.place[found] = np.take_along_axis(sim, order, 1), np.take_along_axis(at, order, 1)

    def found(self) -> pa.RecordBatch:
        """(query_id, neighbor_id, similarity)"""
        i, j = np.nonzero(np.isfinite(self.sim))
        return pa.RecordBatch.from_arrays([self.q_ids.take(pa.array(i)), self.c_ids.take(pa.array(self.place[i, j])), pa.array(self.sim[i, j])], names=["query_id", "neighbor_id", "similarity"])


def nearest_on_grid(queries: DataFrame, corpus: DataFrame, rows: int, columns: int, k: int, exclude_same_id: bool) -> DataFrame:
    """(query_id, neighbor_id, similarity): the k best of every query in every square.

    Where pieces have cells, those of the corpus have each row's number, and those of queries a bit for each number: only
    rows of a cell whose bit is set are compared.
    """
    q_kind, c_kind = (x.schema["ids"].dataType.elementType.simpleString() for x in (queries, corpus))

    def places(name: str, n: int):
        return F.explode(F.when(F.col(name) < 0, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(name))).alias(name)

    def laid(df: DataFrame, mine: str, other: str) -> DataFrame:
        df = df.withColumnRenamed("ids", mine).withColumn(other, F.lit(None).cast(f"array<{c_kind if other == 'c_ids' else q_kind}>"))
        fields = ("q_ids", "c_ids", "size", "data", "cells")
        df = df.select(places("row", rows), "column", *fields).select("row", places("column", columns), *fields)
        return df.select((F.col("row") * columns + F.col("column")).alias("square"), *fields)

    def solve(size: int, asked: list, held: list) -> pa.RecordBatch:
        ids, vectors = zip(*((pa.concat_arrays([i for i, _, _ in side]), np.concatenate([np.frombuffer(d).reshape(len(i), size) for i, d, _ in side])) for side in (asked, held)))
        best = Nearest(ids[0], vectors[0], ids[1], vectors[1], k, exclude_same_id)
        if asked[0][2] is None:
            best.compare(np.arange(len(ids[0])), np.arange(len(ids[1])))
            return best.found()
        cells = np.concatenate([np.frombuffer(c, np.int32) for _, _, c in held])[best.order]
        bits = np.concatenate([np.frombuffer(c, np.uint8).reshape(len(i), -1) for i, _, c in asked])
        order = np.argsort(cells, kind="stable")
        numbers, starts = np.unique(cells[order], return_index=True)
        for cell, at in zip(numbers, np.split(order, starts[1:])):
            best.compare(np.flatnonzero(bits[:, cell >> 3] & (128 >> (cell & 7))), at)
        return best.found()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each square and length the pieces of queries and of the corpus.
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for b in batches:
            for r in range(b.num_rows):
                square, q_ids, c_ids, size, data, cells = (c[r] for c in b.columns)
                sides = held.setdefault((square.as_py(), size.as_py()), ([], []))
                sides[c_ids.is_valid].append(((c_ids if c_ids.is_valid else q_ids).values, data.as_buffer(), cells.as_buffer() if cells.is_valid else None))
        for (_, size), (asked, of) in held.items():
            if asked and of:
                yield solve(size, asked, of)

    squares = laid(queries, "q_ids", "c_ids").unionByName(laid(corpus, "c_ids", "q_ids")).repartitionById(rows * columns, "square")
    return squares.mapInArrow(run, f"query_id {q_kind}, neighbor_id {c_kind}, similarity double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", (1 - F.col("similarity")).alias("distance"))


def knn_positions(query, corpus, *, k: int = 5) -> Column:
    """Positions, from 0, of the k nearest vectors of an array of vectors in the same row; null for a null query or corpus.

    Null vectors of the corpus are passed over but keep their positions. Ties go by position; fewer than k are all given.
    """
    if k < 0:
        raise ValueError("k must not be negative")

    @F.arrow_udf("array<long>")
    def run(q: pa.Array, c: pa.Array) -> pa.Array:
        out: list[list[int] | None] = []
        for v, vectors in zip(q, c):
            if not v.is_valid or not vectors.is_valid:
                out.append(None)
                continue
            held = [(i, x) for i, x in enumerate(vectors.as_py()) if x is not None]
            if not held or not k:
                out.append([])
                continue
            x = np.array([v.as_py()], dtype=np.float64)
            y = np.array([x for _, x in held], dtype=np.float64)
            near = np.round(_unit(y) @ _unit(x)[0], 9)
            out.append([held[j][0] for j in np.argsort(-near, kind="stable")[:k]])
        return pa.array(out, pa.list_(pa.int64()))

    return run(to_col(query).cast("array<double>"), to_col(corpus).cast("array<array<double>>"))


def gather(df: DataFrame, neighbors: DataFrame, *, id_col: str = "id") -> DataFrame:
    """The rows that neighbours name, with the query, rank and distance before them.

    Columns of ``df`` that are named like one of these three have underscores before their names.
    """
    taken = {"query_id", "rank", "distance", "neighbor_id"}
    names = [c if c.lower() not in taken else "_" + c for c in df.columns]
    rows = df.toDF(*names)
    # Aliased apart, as the neighbours may come from the same table.
    n, r = neighbors.select("query_id", "neighbor_id", "rank", "distance").alias("n"), rows.alias("r")
    on = F.col("n.neighbor_id") == F.col(f"r.`{names[df.columns.index(id_col)]}`")
    return n.join(r, on).select("n.query_id", "n.rank", "n.distance", *(F.col(f"r.`{c}`") for c in names))
