"""Packing, mixing, line dedup and SimHash against brute force, on awkward tables and the small test tables."""

import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from sparkloom.llm import common, lines, mixing, packing, registry, simhash

SMALL = "/root/testdata/sf0.001"


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    r = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    at = [names.index(c) for c in df.columns]
    assert sorted(names) == sorted(df.columns)
    assert tuples(df) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("window,weights", [(64, None), (4096, None), (7, {"s0": 3.0, "s1": 1.0, "s9": 1.0, "s2": 0.0})])
def test_packing(docs, rows, window, weights):
    got = tuples(packing.pack(docs, window, weights))
    want = brute.pack([(i, s, brute.n_words(t)) for i, t, _, s, _ in rows], window, weights=weights)
    assert got == sorted(want, key=repr)
    # Nothing is lost and all windows but the last are full.
    used = Counter()
    for w, _, _, _, _, n in got:
        used[w] += n
    assert all(used[w] == window for w in used if w != max(used)) and set(used) == set(range(len(used)))


def test_packing_keeps_proportions(spark):
    rng = random.Random(2)
    data = [(k, " ".join(["w"] * rng.randint(1, 60)), "a" if rng.random() < 0.8 else "b") for k in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    share = packing.pack(df, 512).groupBy("window_id").agg((F.sum(F.when(F.col("source") == "a", F.col("n_tokens")).otherwise(0)) / F.sum("n_tokens")).alias("a"), F.sum("n_tokens").alias("n")).filter("n = 512").collect()
    total = sum(len(t.split()) for _, t, s in data if s == "a") / sum(len(t.split()) for _, t, _ in data)
    # Within a document of each source.
    assert all(abs(r["a"] - total) < 2.5 * 60 / 512 for r in share)


def test_no_range_of_the_stream_is_large(spark):
    """Weights of 10,000 to 1, and a third of the rows of one id: all ranges are of about equally many rows."""
    rng = random.Random(6)
    data = [(7 if k % 3 == 0 else k, " ".join(["w"] * rng.randint(1, 9)), "a" if k % 2 else "b") for k in range(20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    staged = packing.stream(df, 64, {"a": 10_000.0, "b": 1.0}, id_col="doc_id", text_col="text", source_col="source", tokens=common.word_count)
    sizes = [r["count"] for r in staged.groupBy("part").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 4
    assert tuples(packing.pack(df.limit(3000), 64, {"a": 10_000.0, "b": 1.0})) == sorted(brute.pack([(i, s, len(t.split())) for i, t, s in map(tuple, df.limit(3000).collect())], 64, weights={"a": 10_000.0, "b": 1.0}), key=repr)


def test_packing_of_nothing(empty, docs):
    assert packing.pack(empty).count() == 0 and packing.pack(docs.filter("text is null")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 0)


@pytest.mark.parametrize("weights,fractions", [(None, (1.0,)), (None, (0.5, 0.1, 1.0)), ({"s0": 1.0, "s1": 2.0, "s2": 0.5, "absent": 1.0}, (0.3, 1.0))])
def test_mixing(docs, rows, weights, fractions):
    kept = mixing.mix(docs, weights, fractions)
    assert kept.columns == [*docs.columns, "_budget_level", "_n_tokens"]
    want = Counter((rows[r][0], rows[r][1], level, brute.n_words(rows[r][1])) for r, level in brute.mix([(i, s, brute.n_words(t)) for i, t, _, s, _ in rows], weights, fractions))
    assert Counter(map(tuple, kept.select("doc_id", "text", "_budget_level", "_n_tokens").collect())) == want


def test_mixing_of_nothing(empty, docs):
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.filter("text is null")).count() == 0


def test_budgets_nest_and_fit(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    total = {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()}
    weights = {s: 1.0 + k % 3 for k, s in enumerate(sorted(total))}
    most = min(total[s] / weights[s] for s in total)
    for r in mixing.mix(df, weights).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():
        assert r["n"] <= weights[r["source"]] * most + 1e-6


@pytest.mark.parametrize("grouped", [False, True])
def test_line_dedup(spark, docs, rows, grouped):
    same = {r[0]: r[0] % 5 for r in rows if r[0] is not None and r[0] % 3 == 0} if grouped else None
    left = brute.drop_repeats([(i, t) for i, t, *_ in rows], same)
    want = Counter((r[0], t, (r[4] if t == r[1] else len(t))) for r, t in zip(rows, left) if t is not None or r[1] is None)
    out = lines.drop_repeats(docs, same=spark.createDataFrame(list(same.items()), "id long, grp long") if grouped else None)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.select("doc_id", "text", "n_chars").collect())) == want


def test_runs_whose_hashes_collide_stay(spark, docs, rows, monkeypatch):
    """With a hash of few values nearly all that is taken for a repeat is none; only bytes count."""
    plain = lines.occurrences

    def colliding(*args, **options):
        return plain(*args, **options).withColumn("hash", F.pmod("hash", F.lit(40)))

    data = [(i, t) for i, t, *_ in rows if t and len(t) < 3000][:40]
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(lines, "occurrences", colliding)
    kept = Counter(x for r in lines.drop_repeats(df).collect() for x in r["text"].split("\n"))
    # Nothing is lost, whatever collides.
    assert {x for _, t in data for x in t.split("\n") if x.strip()} == {x for x in kept if x.strip()}


def test_null_and_shared_ids_cost_no_more_than_others(spark):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) for _ in range(10)) for _ in range(1000)]
    took = []
    for ids in (range(1000), [None] * 1000, [7] * 1000, range(1000)):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4).cache()
        df.count()
        t = time.perf_counter()
        assert lines.drop_repeats(df).count() == 1000
        took.append(time.perf_counter() - t)
    assert max(took[1:3]) < 1.5 * max(took[0], took[3]) + 1, took


def test_line_dedup_finds_shifted_passages(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(10))
    runs = [[line() for _ in range(16)] for _ in range(8)]
    data = [(100 * n + k, "\n".join([*(line() for _ in range(1 + k % 4)), *run, *(line() for _ in range(1 + k % 3))])) for n, run in enumerate(runs) for k in range(12)]
    kept = lines.drop_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    left = sum(sum(x in r["text"] for x in runs[r["doc_id"] // 100]) for r in kept if r["doc_id"] % 100)
    # Only lines before the first cut that all have and after the last may stay: three or so at either end.
    assert left / (8 * 11 * 16) < 0.4
    long = " ".join(line() for _ in range(6))
    two = lines.drop_repeats(spark.createDataFrame([(1, "a\n" + long), (2, long + "\nb"), (3, "short\nlines"), (4, "short\nother")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in two] == ["a\n" + long, "b", "short\nlines", "short\nother"]


def test_passages_of_a_few_lines_go_whole(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    for n, words in ((2, 30), (3, 20), (4, 15), (5, 10), (8, 7), (3, 25)):
        runs = [[line(words) for _ in range(n)] for _ in range(20)]
        data = [(2 * k + second, "\n".join([*(line(9) for _ in range(1 + rng.randrange(4))), *run, *(line(9) for _ in range(1 + rng.randrange(4)))])) for k, run in enumerate(runs) for second in (0, 1)]
        kept = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
        for i, t in data:
            assert kept[i] == [x for x in t.split("\n") if not (i % 2 and x in runs[i // 2])]


def test_a_passage_stays_once(docs, rows):
    """Of every line a copy stays, and of a common run of 50 words but one."""
    kept = Counter(x for r in lines.drop_repeats(docs).collect() for x in (r["text"] or "").split("\n"))
    assert {x for _, t, *_ in rows if t for x in t.split("\n") if x.strip()} == {x for x in kept if x.strip()}
    passage, run = rows[63][1].split("\n")[-1], rows[67][1].split("\n")
    assert len(passage.split()) == 70 and len(run) == 8
    assert all(kept[x] == 1 for x in (passage, *run))


def test_line_dedup_of_nothing(empty):
    assert lines.drop_repeats(empty).count() == 0


def test_near_duplicates(docs, rows):
    want = brute.near_groups([(i, t) for i, t, *_ in rows])
    got = {r["id"]: r["keeper"] for r in simhash.groups(docs).collect()}
    assert got == want and len(want) >= 3
    gone = {i for i, k in want.items() if i != k}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i not in gone)


def test_near_duplicates_of_nothing(empty, docs):
    assert simhash.groups(empty).count() == 0 and simhash.groups(docs.filter("text is null")).count() == 0


def test_recall(spark):
    """Against all pairs within the budget: 0.9 of those that differ are in one group."""
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    h = simhash.Hasher()
    sigs = [(i, s) for i, t in data if (s := h(t))]
    group = {r["id"]: r["keeper"] for r in simhash.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    pairs = [(i, j) for k, (i, a) in enumerate(sigs) for j, b in sigs[k + 1 :] if a != b and brute.near(a, b)]
    assert len(pairs) > 50 and sum(i in group and group[i] == group.get(j) for i, j in pairs) / len(pairs) >= 0.9


def test_layout_follows_the_number_of_hashes():
    assert simhash.layout(0) == simhash.layout(10**6) == (20, 5)
    for n in (10**9, 10**11):
        bits, orders = simhash.layout(n)
        found = brute.math.prod((220 - i) / (256 - i) for i in range(bits)) * orders * (256 // bits)
        assert bits <= 28 and found >= 60 * brute.math.prod((220 - i) / (256 - i) for i in range(20))


def test_wider_keys_find_as_much(spark):
    rng = brute.np.random.default_rng(7)
    sigs = []
    for _ in range(300):
        a = rng.integers(0, 2, simhash.BITS)
        b = a.copy()
        b[rng.choice(simhash.BITS, 36, replace=False)] ^= 1
        sigs += [bytes(brute.np.packbits(x).tolist()) for x in (a, b)]
    df = spark.createDataFrame(list(enumerate(sigs)), "node long, sig binary")
    assert simhash.edges(df, n=2**31).distinct().count() >= 0.88 * 300


def test_groups_of_other_kinds_of_ids(spark):
    text = " ".join(f"word{k}" for k in range(200))
    data = [("b", text), ("a", text), (None, text), ("c", text + " more"), ("d", "something else"), ("e", None), ("f", "")]
    df = spark.createDataFrame([(*x, 1) for x in data], "keeper string, text string, id int")
    assert sorted(map(tuple, simhash.groups(df, id_col="keeper").collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert sorted(r["keeper"] or "" for r in simhash.keep_one(df, id_col="keeper").collect()) == ["", "a", "d", "e", "f"]
    assert simhash.groups(df.limit(0), id_col="keeper").count() == 0


def test_recall_in_every_band(spark):
    """Hashes that differ in bits chosen evenly: edges() finds 0.9 of the pairs at any distance up to the budget."""
    rng = brute.np.random.default_rng(6)
    bands, sigs = (6, 18, 24, 27, 30, 33, 36), []
    for d in bands:
        for _ in range(400):
            a = rng.integers(0, 2, simhash.BITS)
            b = a.copy()
            b[rng.choice(simhash.BITS, d, replace=False)] ^= 1
            sigs += [bytes(brute.np.packbits(x).tolist()) for x in (a, b)]
    df = spark.createDataFrame(list(enumerate(sigs)), "node long, sig binary")
    found = Counter(min(r["a"], r["b"]) // 800 for r in simhash.edges(df).distinct().collect() if abs(r["a"] - r["b"]) == 1)
    assert all(found[k] >= 0.9 * 400 for k in range(len(bands))), found


def test_many_copies(spark):
    text = " ".join(f"word{k}" for k in range(200))
    df = spark.createDataFrame([(k, text if k % 2 else text + f" more{k}") for k in range(1500)], "doc_id long, text string")
    assert simhash.keep_one(df).count() == 1


def test_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x or any(root(y) == x for y in parent if y != x)}


def test_token_counter(spark):
    count = common.bpe_count("/opt/tokenizers/byte_bpe_50k.tiktoken", r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    assert [r[0] for r in spark.createDataFrame([("hello world",), (None,), ("",)], "t string").select(count(F.col("t"))).collect()] == [2, 0, 0]


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
