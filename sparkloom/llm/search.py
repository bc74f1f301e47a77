"""Exact top-k search (BM25) over inverted indexes: block-at-a-time pruning for short queries, whole scoring for long ones.

Documents are indexed once: cut, as they are stored, into parts, of each part its words' hashes in order with the documents
that have them and their counts. So no pass over the queries sorts postings again or looks one up by its hash. Documents of
a part are cut into blocks of a fixed number. With the corpus's statistics a block's largest contribution of each term is
known, and a short query's bound for a block is the sum over its terms. For every short query blocks are taken in order of
falling bounds and scored by document until the bound falls below the kth score. Bounds of long queries, such as whole
documents, hardly ever fall below it; these are scored against every document by a product of matrices for the terms that
cost most, and by inverted lists for the rare ones. Of the terms between, whose lists are long and whose contributions are
small, a product over blocks gives bounds, and only documents that may still reach the kth score have them added. Nothing is
shuffled but the k best of each query and task.

Contributions are whole millionths, so bounds and scores add up exactly in any order (in doubles too, below 2^53) and ties
are true ties. Words are told apart by hashes of 64 bits.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import written

K1, B, UNIT = 1.2, 0.75, 1_000_000
#: Documents of a block. Small blocks have bounds near their documents' scores: of blocks of 256 documents of prose nearly
#: all must be scored, of these a third.
BLOCK = 8
#: A short query's bounds are taken where its terms have more than so many times as many documents as blocks; else it is scored whole.
WORTH = 4
#: A part, which a task holds at once, ends with the document that brings it to so many words, different words or documents.
HELD, HELD_WORDS, HELD_DOCS = 5_000_000, 500_000, 32_768
#: Queries of more different terms are scored whole; so many of the terms that cost most as a matrix, and of those that follow
#: bounds first; for so many queries at once, of which so many go through the inverted lists at once.
PRUNED_TERMS, DENSE, MIDDLE, AT_ONCE, LISTS_AT_ONCE = 32, 256, 1024, 256, 16
#: The matrix of the latter has so many numbers at most.
MIDDLE_NUMBERS = 10_000_000
#: Sums of 32-bit floats are as right as this for MIDDLE terms, and whole numbers below EXACT are held exactly.
SLACK, EXACT = 1e-4, 1 << 24
#: The most query terms that are sent to the workers at once; more queries are searched in several passes.
SLICE_TERMS = 4_000_000
#: In place of a query: how many blocks were scored, and how many hold a term of the query, over all short queries.
SCORED, BLOCKS = -1, -2
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and _, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


class Queries:
    """Query rows with their terms numbered in order of their hashes. Picklable; its size is bounded by the slice."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        import numpy as np

        self.ids = [i for i, _ in rows]
        known: dict[str, int] = {}
        held = []
        for _, t in rows:
            c = Counter(words(t))
            for w in c:
                if w not in known:
                    known[w] = _hash(w)
            held.append((np.fromiter(map(known.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c))))
        self.hashes = np.unique(np.fromiter(known.values(), np.int64, len(known)))
        #: Of each query the terms' numbers and counts.
        self.terms = [(np.searchsorted(self.hashes, of).astype(np.int32), c) for of, c in held]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every part: its documents' ids and lengths; its terms' hashes in order, and in how many documents each is; by term, then document, the postings' documents and counts."""
    import numpy as np

    def row():
        n = len(lengths)
        hashes, rank = np.unique(np.fromiter(map(_hash, known), np.int64, len(known)), return_inverse=True)
        keys = rank[np.frombuffer(numbers, np.int32)] * n + np.repeat(np.arange(n), np.asarray(lengths, np.int64))
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0])) if n else keys
        counts = np.diff(np.append(first, len(keys)))
        term, doc = np.divmod(keys[first], max(n, 1))
        packed = hashes, *(x.astype(np.int32) for x in (np.bincount(term, minlength=len(hashes)), doc, counts, np.asarray(lengths)))
        values = [pa.array([x], pa.int64()) for x in (n_docs, len(numbers))]
        values.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(ids)))
        return pa.RecordBatch.from_arrays([*values, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["n_docs", "n_tokens", "ids", "terms", "sizes", "docs", "counts", "lengths"])

    n_docs = 0
    for b in batches:
        kept: list[int] = []
        for r, text in enumerate(b.column(1).to_pylist()):
            if not n_docs:
                # Of each word of the part its number.
                known: defaultdict[str, int] = defaultdict()
                known.default_factory = known.__len__
                numbers, lengths, ids = array("i"), [], []
            n_docs += 1
            all_of = words(text)
            if all_of:
                numbers.extend(map(known.__getitem__, all_of))
                lengths.append(len(all_of))
                kept.append(r)
            if len(numbers) >= HELD or len(known) >= HELD_WORDS or n_docs >= HELD_DOCS:
                ids.append(b.column(0).take(pa.array(kept, pa.int64())))
                yield row()
                n_docs, kept = 0, []
        if n_docs:
            ids.append(b.column(0).take(pa.array(kept, pa.int64())))
    if n_docs:
        yield row()


def _number(raw: bytes, hashes):
    """Which of these hashes are the queries', and their numbers."""
    import numpy as np

    terms = np.frombuffer(raw, np.int64)
    at = np.minimum(np.searchsorted(hashes, terms), len(hashes) - 1)
    known = np.flatnonzero(hashes[at] == terms)
    return known, at[known]


def _frequencies(batches: Iterator[pa.RecordBatch], hashes) -> Iterator[pa.RecordBatch]:
    """(term, df): in how many of the task's documents each term is."""
    import numpy as np

    df = np.zeros(len(hashes), np.int64)
    for b in batches:
        for terms, sizes in zip(b.column(0), b.column(1)):
            known, number = _number(terms.as_py(), hashes)
            df[number] += np.frombuffer(sizes.as_py(), np.int32)[known]
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])


def _ranges(starts, sizes, upto):
    """The numbers of ranges, one after another; ``upto`` has the numbers from 0 on, as to make them anew takes longest."""
    import numpy as np

    out = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    out += upto[: len(out)]
    return out


class Part:
    """A part's documents with every posting's contribution, by term; of the terms ``pruned`` also by document and by block."""

    def __init__(self, row: dict, hashes, idf, mean_length: float, pruned):
        import numpy as np

        sizes, docs, counts, lengths = (np.frombuffer(row[c], np.int32) for c in ("sizes", "docs", "counts", "lengths"))
        self.ids = row["ids"]
        self.n_docs = len(self.ids)
        self.n_blocks = -(-self.n_docs // BLOCK)
        known, number = _number(row["terms"], hashes)
        self.start, self.size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        self.start[number], self.size[number] = (np.cumsum(sizes) - sizes)[known], sizes[known]
        weight = np.zeros(len(sizes))
        weight[known] = idf[number]
        norm = K1 * (1 - B + B * lengths / mean_length)
        self.doc, tf = docs.astype(np.int64), counts.astype(np.float64)
        self.gain = np.floor(np.repeat(weight, sizes) * (tf * (K1 + 1) / (tf + norm[self.doc])) * UNIT + 0.5)
        self.upto = np.arange(len(self.doc))
        # Of the pruned terms, by term, then block: the largest contribution.
        sizes = self.size[pruned]
        x = _ranges(self.start[pruned], sizes, self.upto)
        term, doc, gain = np.repeat(pruned, sizes), self.doc[x], self.gain[x]
        block = doc // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(block) != 0)])) if len(x) else x
        self.max_block, self.max_gain = block[first], np.maximum.reduceat(gain, first) if len(x) else gain
        self.max_size = np.bincount(term[first], minlength=len(hashes))
        self.max_start = np.cumsum(self.max_size) - self.max_size
        # By document.
        order = np.argsort(doc, kind="stable")
        self.of_doc, self.of_term, self.of_gain = doc[order], term[order], gain[order]
        self.block_start = np.searchsorted(self.of_doc, np.arange(self.n_blocks + 1) * BLOCK)

    def _sum(self, start, size, at, gain, n: int, terms, counts):
        import numpy as np

        sizes = size[terms]
        x = _ranges(start[terms], sizes, self.upto)
        gains = gain[x]
        if len(counts) and counts.max() > 1:
            gains *= np.repeat(counts, sizes)
        return np.bincount(at[x], gains, n)

    def bounds(self, terms, counts):
        return self._sum(self.max_start, self.max_size, self.max_block, self.max_gain, self.n_blocks, terms, counts)

    def scores(self, terms, counts):
        return self._sum(self.start, self.size, self.doc, self.gain, self.n_docs, terms, counts)

    def worth_bounds(self, terms) -> bool:
        """Whether bounds take so much less than scores that blocks may be worth to be left out."""
        return self.size[terms].sum() > WORTH * self.max_size[terms].sum()

    def scores_of(self, blocks, weights):
        """These blocks' documents and their scores; ``weights`` has the query's count of each term."""
        import numpy as np

        sizes = self.block_start[blocks + 1] - self.block_start[blocks]
        x = _ranges(self.block_start[blocks], sizes, self.upto)
        at = self.of_doc[x] % BLOCK + np.repeat(np.arange(len(blocks)) * BLOCK, sizes)
        docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        return docs, np.bincount(at, self.of_gain[x] * weights[self.of_term[x]], len(docs))

    def dense(self, asked):
        """The terms whose lists cost most (``asked`` has by how many queries each is asked for), and a matrix of the documents and them; the same of those that follow, with their largest contributions to each block, here of documents n_blocks apart."""
        import numpy as np

        cost = self.size * asked
        at = np.argsort(-cost, kind="stable")[: 2 * (DENSE + MIDDLE)]
        at = at[cost[at] > 0]
        at = at[[self.gain[lo : lo + n].max() < EXACT for lo, n in zip(self.start[at], self.size[at])]] if len(at) else at
        # Documents that are missing from the last block have nothing.
        out = []
        for terms in (at[:DENSE], at[DENSE : DENSE + min(MIDDLE, MIDDLE_NUMBERS // max(1, self.n_docs))]):
            sizes = self.size[terms]
            x = _ranges(self.start[terms], sizes, self.upto)
            matrix = np.zeros((self.n_blocks * BLOCK, len(terms)), np.float32)
            matrix[self.doc[x], np.repeat(np.arange(len(terms)), sizes)] = self.gain[x]
            out += [terms, matrix]
        return (*out, out[3].reshape(BLOCK, self.n_blocks, -1).max(0))

    def sums(self, queries: list):
        """A row of scores, over all documents, for each of these (terms, counts)."""
        import numpy as np

        terms = np.concatenate([t for t, _ in queries])
        sizes = self.size[terms]
        ends = np.concatenate([[0], np.cumsum([self.size[t].sum() for t, _ in queries])])
        x = _ranges(self.start[terms], sizes, self.upto if ends[-1] <= len(self.upto) else np.arange(ends[-1]))
        docs, gains = self.doc[x], self.gain[x]
        counts = np.concatenate([c for _, c in queries])
        if len(counts) and counts.max() > 1:
            gains *= np.repeat(counts, sizes)
        return np.array([np.bincount(docs[lo:hi], gains[lo:hi], self.n_blocks * BLOCK) for lo, hi in zip(ends, ends[1:])], np.float64)


class Long:
    """Queries scored against every document of a part. ``completed`` counts the documents whose middle terms were added."""

    def __init__(self, part: Part, asked, n_terms: int):
        import numpy as np

        self.part = part
        self.common, self.matrix, self.middle, self.middles, self.most = part.dense(asked)
        self.rare = np.ones(n_terms, bool)
        self.rare[self.common] = self.rare[self.middle] = False
        self.completed = 0

    def search(self, queries: list, best: list[Best]) -> None:
        """The documents of the part that are among the best for each of these (terms, counts)."""
        import numpy as np

        weights = np.zeros(len(self.rare), np.float32)
        asked, between = (np.zeros((len(queries), len(t)), np.float32) for t in (self.common, self.middle))
        for row, (terms, counts) in enumerate(queries):
            weights[terms] = counts
            asked[row], between[row] = weights[self.common], weights[self.middle]
            weights[terms] = 0
        products = asked @ self.matrix.T
        bounds = between @ self.most.T
        bounds *= 1 + SLACK
        k, n_blocks = best[0].k, self.part.n_blocks
        for lo in range(0, len(queries), LISTS_AT_ONCE):
            rows = slice(lo, lo + LISTS_AT_ONCE)
            listed = self.part.sums([(t[self.rare[t]], c[self.rare[t]]) for t, c in queries[rows]])
            # What the middle terms can only add to, by block; they are added to the best documents first, so that the kth score is known.
            least = (products[rows] + listed).reshape(len(listed), BLOCK, n_blocks)
            tops = least.max(1)
            floors = np.array([b.floor for b in best[rows]], np.float64)
            if n_blocks >= k and any(len(b.held) < k for b in best[rows]):
                block = np.argpartition(-tops, min(2 * k, n_blocks) - 1, axis=1)[:, : 2 * k]
                docs = np.take_along_axis(least, block[:, None, :], 2).argmax(1) * n_blocks + block
                scores = np.take_along_axis(tops, block, 1) + np.matmul(self.middles[docs], between[rows][:, :, None])[:, :, 0]
                floors = np.maximum(floors, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            floors *= 1 - SLACK
            # Blocks first, then their documents.
            q, block = np.nonzero(tops + bounds[rows] >= floors[:, None])
            i, at = np.nonzero(least[q, :, block] >= (floors[q] - bounds[rows][q, block])[:, None])
            q, doc = q[i], at * n_blocks + block[i]
            self.completed += len(q)
            ends = np.searchsorted(q, np.arange(len(listed) + 1))
            for r in range(len(listed)):
                docs = doc[ends[r] : ends[r + 1]]
                if not len(docs):
                    continue
                rest = listed[r, docs]
                known = np.flatnonzero(between[lo + r])
                if len(known):
                    rest += self.middles.ravel().take(docs[:, None] * len(self.middle) + known) @ between[lo + r, known].astype(np.float64)
                near = products[lo + r, docs] + rest
                floor = floors[r]
                if len(near) > k:
                    floor = max(floor, np.partition(near, len(near) - k)[len(near) - k] * (1 - SLACK))
                left = np.flatnonzero(near >= floor)
                docs = docs[left]
                best[lo + r].add(self.part.ids, self.matrix[docs] @ asked[lo + r].astype(np.float64) + rest[left], docs)


class Best:
    """The k best (score, id), ties by id, null first."""

    def __init__(self, k: int):
        self.k, self.floor, self.held = k, 1, []

    def add(self, ids: list, scores, docs=None) -> None:
        """Documents with these scores: all of ``ids`` in order, or those of the numbers ``docs``."""
        import numpy as np

        at = scores >= self.floor
        if np.count_nonzero(at) > self.k:
            at = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
        at = np.flatnonzero(at)
        if len(at):
            found = zip(scores[at].tolist(), (at if docs is None else docs[at]).tolist())
            self.held = sorted([*self.held, *((int(score), ids[i]) for score, i in found)], key=_order)[: self.k]
            if len(self.held) == self.k:
                self.floor = max(self.floor, self.held[-1][0])


def _order(x: tuple) -> tuple:
    return -x[0], x[1] is not None, x[1] if x[1] is not None else 0


def _slice(parts: DataFrame, queries: Queries, k: int, kind, n_docs: int, n_tokens: int, counted: bool) -> DataFrame:
    """(query, doc, score) of the k best of each task, numbers of ``queries`` for queries; under SCORED and BLOCKS, sums."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    hashes = queries.hashes
    df = np.zeros(len(hashes), np.float64)
    # A row for each query term at most.
    for r in parts.select("terms", "sizes").mapInArrow(lambda it: _frequencies(it, hashes), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    idf, mean_length = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), n_tokens / n_docs
    id_type = to_arrow_type(kind)
    short = [q for q, (terms, _) in enumerate(queries.terms) if 0 < len(terms) <= PRUNED_TERMS]
    long = [q for q, (terms, _) in enumerate(queries.terms) if len(terms) > PRUNED_TERMS]
    pruned = np.unique(np.concatenate([queries.terms[q][0] for q in short])) if short else np.zeros(0, np.int32)
    asked_by = np.bincount(np.concatenate([queries.terms[q][0] for q in long]), minlength=len(hashes)) if long else None

    def search(batches):
        best = [Best(k) for _ in queries.terms]
        scored = blocks_in = 0
        weights = np.zeros(len(hashes))
        rows = (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
        for part in (Part(row, hashes, idf, mean_length, pruned) for row in rows if row["ids"]):
            for q in short:
                terms, counts = queries.terms[q]
                if not part.worth_bounds(terms):
                    scores = part.scores(terms, counts)
                    best[q].add(part.ids, scores)
                    n = len(np.unique(np.flatnonzero(scores) // BLOCK)) if counted else 0
                    scored, blocks_in = scored + n, blocks_in + n
                    continue
                bounds = part.bounds(terms, counts)
                blocks_in += int((bounds > 0).sum())
                order = np.argsort(-bounds, kind="stable")
                weights[terms] = counts
                # More at a time as it goes on, so that the kth score is known early.
                at, size = 0, 2
                while at < len(order):
                    some = order[at : at + size]
                    some = some[bounds[some] >= best[q].floor]
                    if not len(some):
                        break
                    scored += len(some)
                    docs, scores = part.scores_of(some, weights)
                    best[q].add(part.ids, scores, docs)
                    at, size = at + size, 2 * size
                weights[terms] = 0
            if not long:
                continue
            whole = Long(part, asked_by, len(hashes))
            for lo in range(0, len(long), AT_ONCE):
                some = long[lo : lo + AT_ONCE]
                whole.search([queries.terms[q] for q in some], [best[q] for q in some])
        rows = [(q, doc, score) for q, b in enumerate(best) for score, doc in b.held]
        rows += [(SCORED, None, scored), (BLOCKS, None, blocks_in)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc", "score"])

    return parts.mapInArrow(search, f"query int, doc {kind.simpleString()}, score long")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text", report: dict[str, int] | None = None) -> DataFrame:
    """(query id, doc id, rank, score): for every query row its k best documents by BM25, exactly.

    Every row is a query and every row a document: repeated rows are ranked each. Ties go by the document's id (null
    first). Only documents that share a word with the query are found; queries without words, null or empty, find
    nothing. Null and empty documents are never found but count in the statistics; texts are read whole, however long. An
    empty table on either side gives no rows. Should both ids be named alike, the query's has ``query_`` before it; rank
    and score have underscores before them where an id is named so. Other columns are ignored.

    The corpus is indexed once, in the shared folder. Queries are searched in passes; of a pass only the result, written
    there too, is kept. ``report`` gets how many blocks were ``scored`` of all the ``blocks`` that hold a term of the query,
    over all queries of at most PRUNED_TERMS terms.
    """
    spark: SparkSession = docs.sparkSession
    out_id = query_id_col if query_id_col.lower() != id_col.lower() else f"query_{query_id_col}"
    n_terms = F.coalesce(F.regexp_count(query_text_col, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))
    asked = queries.select(F.col(query_id_col).alias("id"), F.col(query_text_col).alias("text"), n_terms.alias("n"))
    total = asked.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-total // SLICE_TERMS))
    query_kind, doc_kind = queries.schema[query_id_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    rank_name, score_name = (common.fresh([out_id, id_col], x) for x in ("rank", "score"))
    out = spark.createDataFrame([], f"`{out_id}` {query_kind}, `{id_col}` {doc_kind}, `{rank_name}` int, `{score_name}` double")
    if not total:
        return out
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # A file for each part: a reader takes a file's rows at once.
    parts = written(texts.mapInArrow(_index, f"n_docs long, n_tokens long, ids array<{doc_kind}>, terms binary, sizes binary, docs binary, counts binary, lengths binary"), maxRecordsPerFile=1)
    n_docs, n_tokens = parts.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    for p in range(passes if n_tokens else 0):
        rows = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == p).collect()
        q = Queries([(r["id"], r["text"]) for r in rows])
        if not len(q.hashes):
            continue
        found = written(_slice(parts, q, k, docs.schema[id_col].dataType, n_docs, n_tokens, report is not None))
        for r in found.filter("query < 0").groupBy("query").agg(F.sum("score").alias("n")).collect() if report is not None else ():
            name = "scored" if r["query"] == SCORED else "blocks"
            report[name] = report.get(name, 0) + r["n"]
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc")))
        names = spark.createDataFrame(list(enumerate(q.ids)), f"query int, id {query_kind}")
        # A row for each query of the pass.
        best = found.filter("query >= 0").withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(names), "query")
        best = best.select(F.col("id").alias(out_id), F.col("doc").alias(id_col), F.col("rank").alias(rank_name), (F.col("score") / UNIT).alias(score_name))
        out = best if passes == 1 else out.unionByName(written(best))
    return out


#: The documents asked for are those of ids that this divides.
TOP, EACH = 10, 50


def op10(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item, and for every document whose id EACH divides (itself among them)."""
    docs, items = (common.table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    asked = items.select(F.struct(F.lit("benchmark").alias("asked"), F.col("item_id").cast("long").alias("id")).alias("item"), "text")
    asked = asked.unionByName(docs.filter(F.col("doc_id") % EACH == 0).select(F.struct(F.lit("documents").alias("asked"), F.col("doc_id").cast("long").alias("id")).alias("item"), "text"))
    return top_k(docs, asked, TOP, query_id_col="item").select("item.asked", F.col("item.id").alias("item_id"), "doc_id", "rank", "score")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
n AS (SELECT count(*) AS n_docs, sum(coalesce(len(w), 0))::DOUBLE / count(*) AS mean FROM d),
p AS (SELECT doc_id, len(any_value(w)) AS length, t, count(*)::DOUBLE AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY doc_id, t),
f AS (SELECT t, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p CROSS JOIN n GROUP BY t),
g AS (SELECT doc_id, p.t, CAST(floor(idf * (tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * length / mean))) * {UNIT} + 0.5) AS BIGINT) AS gain
      FROM p JOIN f ON p.t = f.t CROSS JOIN n),
a AS (SELECT 'benchmark' AS asked, item_id, text FROM benchmark UNION ALL SELECT 'documents', doc_id, text FROM documents WHERE doc_id % {EACH} = 0),
q AS (SELECT asked, item_id, t, count(*) AS c FROM (SELECT asked, item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM a) GROUP BY asked, item_id, t),
s AS (SELECT asked, item_id, doc_id, CAST(sum(gain * c) AS BIGINT) AS score FROM g JOIN q ON g.t = q.t GROUP BY asked, item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY asked, item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT asked, item_id, doc_id, CAST(rank AS INTEGER) AS rank, score / {UNIT} AS score FROM r WHERE rank <= {TOP}
"""
