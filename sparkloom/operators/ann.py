"""Approximate nearest neighbours by inverted lists.

Centres are fitted by spherical k-means on a bounded sample of the corpus; every row of the corpus is then indexed in the
cell of its nearest centre. A query is compared, exactly, with all rows of the ``probes`` cells whose centres are nearest to
it, so distances are exact and only which rows are looked at is approximate. With as many probes as cells nothing is missed.

Cells are put together into columns of a grid, of bounded parts of the corpus; a cell that holds more is split over several.
A query is sent once to every column that holds a cell it asks for, however many it asks for there, with a bit for each. So
what is shuffled grows with the rows times columns and not times ``probes``. There is no cross join and no broadcast but that
of the centres, whose number is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import PIECE, _matrix, _unit, best_of, gathered, nearest_on_grid, parts_of, piece, rows_of

#: The most centres, and the most rows of the corpus on which they are fitted.
MOST_CELLS, SAMPLE = 4096, 20_000
#: Rows of the corpus, and queries, of a task below which no further tasks are made.
CELL_ROWS, CELL_QUERIES = 8192, 4096
ROUNDS = 10
#: Rows of the sample whose own neighbours tell how many cells must be looked at.
ASKED = 500


def fit(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of the rows of ``vectors``, at most ``cells``; the same for the same rows in the same order."""
    x = _unit(vectors.astype(np.float64)).astype(np.float32)
    cells = min(cells, len(x))
    centres = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        at = _nearest(x, centres, 1)[:, 0]
        order = np.argsort(at, kind="stable")
        used, starts = np.unique(at[order], return_index=True)
        # A centre without rows stays where it is.
        centres = centres.copy()
        centres[used] = _unit(np.add.reduceat(x[order], starts, axis=0))
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of every row."""
    out = np.empty((len(x), n), np.int64)
    for lo in range(0, len(x), 4096):
        near = x[lo : lo + 4096] @ centres.T
        out[lo : lo + 4096] = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.arange(near.shape[1])
    return out


def enough_probes(vectors: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many cells the first rows of a sample must look at to find that share of their k nearest rows in it."""
    x = _unit(vectors.astype(np.float64)).astype(np.float32)
    if len(x) < 2 or len(centres) < 2:
        return len(centres)
    asked = x[:ASKED]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    n = min(max(k, 1), len(x) - 1)
    found = np.argpartition(-near, n - 1, axis=1)[:, :n]
    own = _nearest(x, centres, 1)[:, 0]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[found], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def _by_cell(b: pa.RecordBatch, centres: np.ndarray, probes: int) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """(cell, rows of the batch, length, their unit vectors). Vectors of another length than the centres' have a cell for each length."""
    sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = _unit(_matrix(b.column(1).take(pa.array(at)))) if size else np.zeros((len(at), 0))
        if size != centres.shape[1]:
            yield -1 - int(size), at, int(size), x
            continue
        cells = _nearest(x.astype(np.float32), centres, min(probes, len(centres)))
        flat, row = cells.ravel(), np.repeat(np.arange(len(at)), cells.shape[1])
        order = np.argsort(flat, kind="stable")
        found, starts = np.unique(flat[order], return_index=True)
        for cell, part in zip(found, np.split(order, starts[1:])):
            yield int(cell), at[row[part]], int(size), x[row[part]]


def _counts(rows: DataFrame, centres: np.ndarray, probes: int) -> dict[int, int]:
    """Rows of each cell: as many numbers as there are cells, and lengths of vectors."""

    def run(batches):
        for b in gathered(batches):
            if b.num_rows:
                found = [(cell, len(at)) for cell, at, _, _ in _by_cell(b, centres, probes)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["cell", "n"])

    return {r["cell"]: r["n"] for r in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def columns_of(counts: dict[int, int], most: int) -> tuple[dict[int, tuple[int, int, int]], list[list[int]]]:
    """Of every cell its first column, how many columns it is split over, and its number in them; and the cells of each column."""
    at, cells, held = {}, [], most
    for cell, n in sorted(counts.items()):
        if n > most:
            at[cell] = (len(cells), -(-n // most), 0)
            cells += [[cell]] * at[cell][1]
            held = most
            continue
        if held + n > most:
            cells.append([])
            held = 0
        at[cell] = (len(cells) - 1, 1, len(cells[-1]))
        cells[-1].append(cell)
        held += n
    return at, cells


def _corpus(rows: DataFrame, centres: np.ndarray, at: dict[int, tuple[int, int, int]]) -> DataFrame:
    """The corpus in pieces, by column, with each row's cell."""

    def run(batches):
        first = TaskContext.get().partitionId()
        for b in gathered(batches):
            held: dict[tuple[int, int], list] = {}
            for cell, of, size, x in _by_cell(b, centres, 1):
                column, split, number = at[cell]
                for s in range(split):
                    mine = (np.arange(len(of)) + first) % split == s
                    held.setdefault((column + s, size), []).append((of[mine], x[mine], np.full(mine.sum(), number, np.int32)))
                first += len(of)
            for (column, size), found in held.items():
                of, x, numbers = (np.concatenate(v) for v in zip(*found))
                if len(of):
                    yield piece(b.column(0).take(pa.array(of)), -1, column, size, x, numbers)

    return rows.mapInArrow(run, f"ids array<{rows.schema['id'].dataType.simpleString()}>, {PIECE}")


def _queries(rows: DataFrame, centres: np.ndarray, probes: int, cells: list[list[int]], parts: int) -> DataFrame:
    """The queries in pieces, by row and by each column that holds a cell they ask for, with a bit for each cell there."""

    def run(batches):
        first = TaskContext.get().partitionId()
        for b in gathered(batches):
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            vectors, place = {}, np.empty(b.num_rows, np.int64)
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                place[of] = np.arange(len(of))
                vectors[size] = _unit(_matrix(b.column(1).take(pa.array(of)))) if size else np.zeros((len(of), 0))
            asking = {cell: of for cell, of, _, _ in _by_cell(b, centres, probes)}
            row = (np.arange(b.num_rows) + first) % parts
            first += b.num_rows
            for column, here in enumerate(cells):
                bits = np.zeros((b.num_rows, len(here)), bool)
                for number, cell in enumerate(here):
                    bits[asking.get(cell, []), number] = True
                some = bits.any(1)
                for size, x in vectors.items():
                    for r in range(parts):
                        of = np.flatnonzero(some & (sizes == size) & (row == r))
                        if len(of):
                            yield piece(b.column(0).take(pa.array(of)), r, column, int(size), x[place[of]], np.packbits(bits[of], axis=1))

    return rows.mapInArrow(run, f"ids array<{rows.schema['id'].dataType.simpleString()}>, {PIECE}")


def knn_approx(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    *,
    cells: int | None = None,
    probes: int | None = None,
    recall: float = 0.97,
    sample: int = SAMPLE,
    query_id: str = "id",
    query_vector: str = "embedding",
    corpus_id: str = "id",
    corpus_vector: str = "embedding",
    exclude_same_id: bool = False,
) -> DataFrame:
    """(query_id, neighbor_id, rank, distance): as ``knn_join``, looking only at the ``probes`` cells nearest to each query.

    ``cells`` is the root of the corpus's rows by default, MOST_CELLS at most. ``probes`` is by default as many as some rows
    of the sample need to find ``recall`` of their neighbours in it: few where vectors lie in clusters, most of the cells
    where they lie anywhere. Centres are fitted on ``sample`` rows at most, those of the least hash of their ids. A query may
    find fewer than k neighbours if its cells hold fewer. Nulls, ties, lengths and k are treated as in ``knn_join``.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    q, c = rows_of(queries, query_id, query_vector), rows_of(corpus, corpus_id, corpus_vector)
    if cells is None:
        cells = min(MOST_CELLS, max(1, round(c.count() ** 0.5)))
    drawn = c.select("v").orderBy(F.xxhash64("id"), "id").limit(min(sample, 64 * min(cells, MOST_CELLS))).toArrow().column(0)
    # The centres are of the length that most of the sample has.
    lengths = pc.list_value_length(drawn).to_numpy()
    size = max(Counter(lengths.tolist()).items(), key=lambda x: (x[1], x[0]), default=(0, 0))[0]
    x = np.concatenate([_matrix(v.filter(pc.equal(pc.list_value_length(v), size))).reshape(-1, size) for v in drawn.chunks]) if size else np.zeros((0, 0))
    centres = fit(x, min(cells, MOST_CELLS)) if len(x) and size else np.zeros((1, size), np.float32)
    probes = enough_probes(x, centres, k, recall) if probes is None else max(1, probes)
    counts = _counts(c, centres, 1)
    (n_queries, numbers), n_rows = q.agg(F.count("*"), F.sum(F.size("v"))).first(), sum(counts.values())
    spark = queries.sparkSession
    # A split cell's columns and the last of others may be less than full, so that there are twice as many at most.
    at, of_column = columns_of(counts, max(1, -(-n_rows // parts_of(spark, n_rows, 8 * n_rows * size, CELL_ROWS))))
    rows = parts_of(spark, n_queries, 8 * (numbers or 0), CELL_QUERIES)
    return best_of(nearest_on_grid(_queries(q, centres, probes, of_column, rows), _corpus(c, centres, at), rows, max(1, len(of_column)), k, exclude_same_id), k)
