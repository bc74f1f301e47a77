"""Near-duplicate documents by SimHash with pigeonring filtering.

A document's 256-bit SimHash weighs its distinct words by 1 + log of their count. The bits are laid out in several fixed
random orders, each a ring that is cut into keys. Hashes that agree in a key are candidates; before they are compared in
full, the chain of segments that begins with the key must stay, segment by segment, within budgets in proportion to the
bits it spans. By the pigeonring theorem some chain of every pair within the budget does; as only chains that begin with
an equal key are tried, their budgets have SLACK bits more.

That search is approximate: a pair that shares no key, or none whose chain holds, is missed. So a second one, exact,
follows for the hashes that aren't connected yet. The bits are cut into segments with radii whose sum is less than the budget
by one less than their number, so a pair within the budget is within the radius in some segment; of every segment all keys
within the radius are looked up. Blocks of hashes meet on a grid, so its work grows with the square of the hashes, if by a
small share of their pairs.

The width of the keys follows the number of hashes, and the number of orders follows the width, so that a key has few
chance members and recall is the same at any size. No key's group is capped: a group is searched from member to member
among those not reached yet, so a group of thousands of copies gives thousands of edges, not millions, and takes as many
comparisons. Equal hashes are first made one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import fresh, join_hot, per_batch, written

BITS = 256
BYTES = BITS // 8
#: Bits of a segment, segments of a chain: its end is that of the first 64-bit word.
SEGMENT_BITS, CHAIN = 16, 4
#: The most bits in which near-duplicates differ, and by how many the chains' budgets are wider.
BUDGET, SLACK = 36, 8
#: Narrowest and widest keys; as many keys of the narrowest width as give the recall.
KEY_BITS, KEY_BITS_MOST, KEYS = 20, 28, 60
#: Hashes that may share a key by chance.
MATES = 256
#: Groups of up to so many are compared all at once.
SMALL = 16
#: The radius of the exact search's segments; the widest key of one; hashes of a block at most, and fewest blocks (for enough tasks).
RADIUS, WIDEST, BLOCK, BLOCKS = 2, 22, 1 << 19, 6
#: Ranges longer than this are looked through for those connected already; candidates compared at once.
LONG, AT_ONCE = 32, 1 << 20
#: Words whose bits a worker remembers.
CACHE = 150_000
_WORD = re.compile(r"\w+")


class Hasher:
    def __init__(self) -> None:
        import numpy as np

        self.at: dict[str, int] = {}
        self.rows = np.empty((CACHE, BITS), dtype=np.int8)

    def _learn(self, words: list[str]) -> None:
        import numpy as np
        import xxhash

        raw = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass"), seed=s) for w in words for s in range(BITS // 128))
        k = len(self.at)
        self.rows[k : k + len(words)] = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(words), BITS).astype(np.int8) * 2 - 1
        self.at.update(zip(words, range(k, k + len(words))))

    def __call__(self, text: str | None) -> bytes | None:
        """32 bytes; None for a text without words. Words are of letters, digits and _, in lower case."""
        import numpy as np

        counts = Counter(_WORD.findall(text.lower())) if text else None
        if not counts:
            return None
        total = np.zeros(BITS, dtype=np.float32)
        words = list(counts)
        for i in range(0, len(words), CACHE // 2):
            part = words[i : i + CACHE // 2]
            new = [w for w in part if w not in self.at]
            if len(self.at) + len(new) > CACHE:
                self.at.clear()
                new = part
            if new:
                self._learn(new)
            weights = np.fromiter((_weight(counts[w]) for w in part), dtype=np.float32, count=len(part))
            total += weights @ self.rows[[self.at[w] for w in part]]
        return np.packbits(total > 0).tobytes()


_WEIGHTS = [0.0, *(1 + math.log(n) for n in range(1, 64))]


def _weight(n: int) -> float:
    return _WEIGHTS[n] if n < 64 else 1 + math.log(n)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig) of the rows whose text has a word."""

    def make():
        h = Hasher()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            sig = pa.array([h(t) for t in b.column(1).to_pylist()], pa.binary())
            out = pa.RecordBatch.from_arrays([b.column(0), sig], names=["id", "sig"])
            return out.filter(sig.is_valid())

        return run

    return per_batch(docs, [id_col, text_col], make, f"`id` {docs.schema[id_col].dataType.simpleString()}, sig binary")


def layout(n: int) -> tuple[int, int]:
    """(bits of a key, orders) for so many hashes."""
    bits = max(KEY_BITS, min(KEY_BITS_MOST, (n // MATES).bit_length()))
    equal = lambda k: math.prod((BITS - BUDGET - i) / (BITS - i) for i in range(k))
    keys = math.ceil(KEYS * equal(KEY_BITS) / equal(bits))
    return bits, -(-keys // (BITS // bits))


def _chained(a, b, budget: int):
    """Which pairs of first words have a chain within its budgets: after every segment, those in proportion to its bits."""
    import numpy as np

    differ = a ^ b
    ok = np.bitwise_count(differ) <= _limit(CHAIN, budget)
    for k in range(2, CHAIN):
        ok &= np.bitwise_count(differ & np.uint64((1 << SEGMENT_BITS * k) - 1)) <= _limit(k, budget)
    return ok


def _limit(segments: int, budget: int) -> int:
    return -(-segments * SEGMENT_BITS * (budget + SLACK) // BITS)


def join_within(words, budget: int):
    """Pairs (a, b) of row numbers that join the near-duplicates among ``words`` (n x 4, each beginning with the key).

    Rows whose chain and whole distance are within their budgets are connected by the pairs, which are fewer than the
    rows: each row is compared with those that no row before has reached.
    """
    import numpy as np

    pairs = []
    left = np.arange(len(words))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.flatnonzero(_chained(words[left, 0], words[x, 0], budget))
            if len(near):
                near = near[np.bitwise_count(words[left[near]] ^ words[x]).sum(1, dtype=np.uint16) <= budget]
            if len(near):
                hit = left[near].tolist()
                pairs += [(x, y) for y in hit]
                reached += hit
                left = np.delete(left, near)
    return pairs


def _all_within(words, node, sizes, budget: int):
    """(a, b) nodes within the budget among rows that lie in groups of ``sizes`` one after another."""
    import numpy as np

    ends = np.repeat(np.cumsum(sizes), sizes)
    left = ends - np.arange(len(ends)) - 1
    i, step = np.flatnonzero(left >= 1), 1
    while len(i):
        ok = i[_chained(words[i, 0], words[i + step, 0], budget)]
        ok = ok[np.bitwise_count(words[ok] ^ words[ok + step]).sum(1, dtype=np.uint16) <= budget]
        yield from zip(node[ok].tolist(), node[ok + step].tolist())
        step += 1
        i = i[left[i] >= step]


def _words(column: pa.Array):
    """A column of 32 bytes each as rows of four 64-bit words."""
    import numpy as np

    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(data, np.uint64, count=4 * len(column), offset=int(at)).reshape(-1, 4)


def edges(distinct: DataFrame, budget: int = BUDGET, n: int | None = None) -> DataFrame:
    """(a, b) numbers of near-duplicates among ``distinct`` (node long, sig), enough to connect all that were found; ``n`` is how many it has."""
    bits, orders = layout(distinct.count() if n is None else n)
    rows = distinct.select("node", "sig").mapInArrow(lambda batches: _keys(batches, bits, orders), "key long, node long, sig binary")
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # Sorted partitions are read as a stream: a group is held whole, a partition never is.
    sorted_rows = rows.repartition(int(parts), "key").sortWithinPartitions("key")

    def run(batches):
        import numpy as np

        held: list[tuple] = []  # of the last key, which may go on in the next batch
        last = None
        out: set[tuple[int, int]] = set()  # one pair has many keys

        def found(node, words):
            out.update((int(node[x]), int(node[y])) for x, y in join_within(words, budget))

        def flush():
            if sum(len(x[0]) for x in held) > 1:
                found(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

        for b in batches:
            if not b.num_rows:
                continue
            key, node, words = b.column(0).to_numpy(), b.column(1).to_numpy(), _words(b.column(2))
            at = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], at]), np.concatenate([at, [len(key)]])
            if key[0] != last:
                flush()
                held, last = [], key[0]
            held.append((node[: ends[0]], words[: ends[0]]))
            if len(starts) > 1:
                flush()
                sizes = ends[1:-1] - starts[1:-1]
                for g in np.flatnonzero(sizes > SMALL) + 1:
                    found(node[starts[g] : ends[g]], words[starts[g] : ends[g]])
                few = (sizes > 1) & (sizes <= SMALL)
                rows = np.flatnonzero(np.repeat(few, sizes)) + ends[0]
                out.update(_all_within(words[rows], node[rows], sizes[few], budget))
                held, last = [(node[starts[-1] :].copy(), words[starts[-1] :].copy())], key[-1]
            if len(out) > 50_000:
                yield _pairs(out)
                out.clear()
        flush()
        if out:
            yield _pairs(out)

    return sorted_rows.mapInArrow(run, "a long, b long")


def _pairs(x):
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in x], pa.int64()), pa.array([p[1] for p in x], pa.int64())], names=["a", "b"])


def _keys(batches, key_bits: int, orders: int):
    """Every key of every hash: the number of the key, then its bits; with the hash's bits in that order, turned so that the key comes first."""
    import numpy as np

    per, powers = BITS // key_bits, (1 << np.arange(key_bits)).astype(np.float64)
    laid = [np.random.Generator(np.random.PCG64(p)).permutation(BITS) for p in range(orders)]
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.unpackbits(_words(b.column(1)).view(np.uint8), axis=1)
        for p, order in enumerate(laid):
            for j in range(per):
                bits = sig[:, np.roll(order, -j * key_bits)]
                key = (bits[:, :key_bits] @ powers).astype(np.int64) + (np.int64(p * per + j) << key_bits)
                data = np.packbits(bits, axis=1).tobytes()
                turned = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.arange(0, len(data) + 1, BYTES, dtype=np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), turned], names=["key", "node", "sig"])


def segments(budget: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of segments in one of which every pair within the budget is within the radius.

    A pair that is within it in none differs in the sum of (radius + 1) bits at least: in more than the budget.
    """
    radii = [RADIUS] * (budget // (RADIUS + 1)) + [budget % (RADIUS + 1)]
    # Narrower where fewer bits may differ: about as many chance candidates each.
    shares = [3 + r for r in radii]
    ends = [BITS * sum(shares[: i + 1]) // sum(shares) for i in range(len(radii))]
    return [(a, min(z - a, WIDEST), r) for a, z, r in zip([0, *ends], ends, radii)]


def _key(words, at: int, bits: int):
    """Bits from ``at`` on as a number."""
    import numpy as np

    byte = min(at // 8, BYTES - 4)
    four = np.ascontiguousarray(words.view(np.uint8).reshape(-1, BYTES)[:, byte : byte + 4]).view(">u4").ravel().astype(np.int64)
    return (four >> (32 - (at - 8 * byte) - bits)) & ((1 << bits) - 1)


def links(a, a_label, b, b_label, budget: int) -> set[tuple[int, int]]:
    """Pairs of different labels of rows of ``a`` and ``b`` (n x 4 words) that are within the budget: all of them, exactly."""
    import itertools

    import numpy as np

    out: set[tuple[int, int]] = set()
    n_labels = int(max(a_label.max(), b_label.max())) + 1

    def compare(rows, lo, n):
        """Rows of ``b`` with ``n`` rows of ``a`` each, from ``lo`` on."""
        rows, lo, n = rows[n > 0], lo[n > 0], n[n > 0]
        while len(n):
            # As many ranges as fit; of one that is too long a part.
            total = np.cumsum(n)
            upto = max(1, int(np.searchsorted(total, AT_ONCE, "right")))
            size = np.minimum(n[:upto], AT_ONCE)
            x = np.repeat(lo[:upto] - np.cumsum(size) + size, size) + np.arange(size.sum())
            y = np.repeat(rows[:upto], size)
            ok = np.flatnonzero((sa_label[x] != sb_label[y]) & (np.bitwise_count(sa[x, 0] ^ sb[y, 0]) + np.bitwise_count(sa[x, 1] ^ sb[y, 1]) <= budget))
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(sa[x] ^ sb[y]).sum(1, dtype=np.uint16) <= budget
            pairs = np.unique(sa_label[x[ok]] * n_labels + sb_label[y[ok]])
            out.update(zip((pairs // n_labels).tolist(), (pairs % n_labels).tolist()))
            rest = int(n[0] - size[0]) if upto == 1 else 0
            if rest:
                lo, n = lo.copy(), n.copy()
                lo[0], n[0] = lo[0] + size[0], rest
            else:
                rows, lo, n = rows[upto:], lo[upto:], n[upto:]

    for at, bits, radius in segments(budget):
        a_key, b_key = _key(a, at, bits), _key(b, at, bits)
        by, of = np.lexsort((a_label, a_key)), np.argsort(b_key, kind="stable")
        sa, sa_label, sb, sb_label, b_key = a[by], a_label[by], b[of], b_label[of], b_key[of]
        both = a_key[by] * n_labels + sa_label
        start = np.concatenate([[0], np.cumsum(np.bincount(a_key, minlength=1 << bits))])
        for r in range(min(radius, bits) + 1):
            for flipped in itertools.combinations(range(bits), r):
                key = b_key ^ sum(1 << i for i in flipped)
                lo = start[key]
                n = start[key + 1] - lo
                rows = np.flatnonzero(n)
                lo, n, key = lo[rows], n[rows], key[rows]
                many = n > LONG
                if many.any():
                    # Less those of the row's own label, which lie together.
                    own = key[many] * n_labels + sb_label[rows[many]]
                    first, last = np.searchsorted(both, own), np.searchsorted(both, own, "right")
                    compare(rows[many], lo[many], first - lo[many])
                    compare(rows[many], last, lo[many] + n[many] - last)
                    rows, lo, n = rows[~many], lo[~many], n[~many]
                compare(rows, lo, n)
    return out


def missed(labelled: DataFrame, budget: int, n: int) -> DataFrame:
    """(a, b): labels that near-duplicates among the ``n`` rows of ``labelled`` (label long, sig) connect, besides equal labels; exact."""
    n_blocks = max(BLOCKS, -(-n // BLOCK))
    cells = n_blocks * (n_blocks + 1) // 2
    block, other = F.pmod(F.xxhash64("sig"), F.lit(n_blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    rows = labelled.select("label", "sig", block.alias("block"), other)
    rows = rows.select((F.least("block", "other") * n_blocks + F.greatest("block", "other")).alias("cell"), "block", "label", "sig")
    parts = max(cells, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(key, table):
        import numpy as np

        table = table.combine_chunks()
        names, label = np.unique(table["label"].to_numpy(), return_inverse=True)
        words, block = _words(table["sig"].combine_chunks()), table["block"].to_numpy()
        first, last = divmod(key[0].as_py(), n_blocks)
        a, b = block == first, block == last
        found = links(words[a], label[a], words[b], label[b], budget) if a.any() and b.any() else ()
        x, y = (names[np.array([p[i] for p in found], np.int64)] for i in (0, 1))
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    # Numbered partitions aren't joined, so cells are tasks.
    return rows.repartition(parts, "cell").groupBy("cell").applyInArrow(run, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected part, for every node of ``pairs`` (a, b).

    Large-star and small-star by turns until nothing changes; each round is written to the shared folder.
    """
    e = written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large-star: every greater neighbour of a node goes to the node's least.
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: a node and its lesser neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = written(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, budget: int = BUDGET, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keeper) of every document that has a near-duplicate; the keeper is the least id of its group.

    Ids may be of any type that has an order. Null ids, and texts without a word (null, empty, only signs), are in no
    group. Rows of one id count as that document's; its hashes join. Equal texts, however many, are one hash. No pair
    of hashes within the budget is missed. Groups are closed: near-duplicates of near-duplicates are in one. Texts are read whole, however long. An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    sigs = signatures(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col="id", text_col="text")
    if not whole:
        # Ids are numbered, and named again at the end.
        given = written(sigs)
        names = written(given.select(F.col("id").alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()))
        sigs = given.withColumnRenamed("id", "name").join(names, "name").select("id", "sig")
    sigs = written(sigs.withColumn("id", F.col("id").cast("long")))
    distinct = written(sigs.groupBy("sig").agg(F.min("id").alias("node"), F.max("id").alias("top"), F.count("*").alias("n")))
    total, n = (x or 0 for x in distinct.agg(F.sum("n"), F.count("*")).first())
    near = edges(distinct, budget, n)
    rows = written(join_hot(sigs, distinct, "sig", total).select("id", "node", (F.col("top") > F.col("node")).alias("copied")))
    # Several hashes of one id join by it.
    several = rows.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("id", "lo")
    same = rows.join(several, "id").filter("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    parts = components(near.unionByName(same)).select(F.col("node").alias("member"), "root")
    labelled = distinct.join(parts, F.col("node") == F.col("member"), "left").select(F.coalesce("root", "node").alias("label"), "sig")
    more = written(missed(labelled, budget, n).distinct())
    if not more.isEmpty():
        parts = components(more.unionByName(parts.select(F.col("member").alias("a"), F.col("root").alias("b")))).select(F.col("node").alias("member"), "root")
    out = rows.join(parts, F.col("node") == F.col("member"), "left").filter("copied or root is not null").select("id", F.coalesce("root", "node").alias("keeper")).distinct()
    if whole:
        return out.select(F.col("id").cast(kind), F.col("keeper").cast(kind))
    out = written(out.join(names, "id").select("keeper", "name"))
    least = out.groupBy(F.col("keeper").alias("root")).agg(F.min("name").alias("least"))
    return out.join(least, F.col("keeper") == F.col("root")).select(F.col("name").alias("id"), F.col("least").alias("keeper"))


def keep_one(docs: DataFrame, budget: int = BUDGET, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the near-duplicates: of each group the document of the least id stays (all its rows, if repeated).

    Null ids, and texts without a word, stay. All columns pass through, whatever their names; an empty table gives an empty one.
    """
    gone = fresh(docs.columns, "_gone")
    out = groups(docs, budget, id_col=id_col, text_col=text_col).filter("id <> keeper").select(F.col("id").alias(gone))
    return docs.join(out, F.col(id_col) == F.col(gone), "left_anti")


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document that has a near-duplicate, with the one of its group that stays."""
    return groups(common.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("keeper").alias("keeper_id"))
