"""The pipeline's rows against a brute-force version of all its stages."""

from collections import Counter

import brute
import corpus_pipeline as pipeline
from sparkloom.llm import packing, simhash, toxicity

SMALL = "/root/testdata/sf0.01"


def test_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    known = sorted((brute.h60(f"{i}toxicity"), i, labels[i], t) for i, t, *_ in docs if i in labels and t is not None and len(t) <= 20_000)
    m = toxicity.fit(*([t for _, _, y, t in known if y == label][:most] for label, most in ((1, 3000), (0, 6000))))
    if m is not None:
        g = toxicity.Gains(m.toxic, m.ordinary, m.window_gain)
        docs = [d for d in docs if g.scores([d[1]])[0] < m.threshold]
    left = brute.drop_repeats([(d[0], d[1]) for d in docs], brute.near_groups([(d[0], d[1]) for d in docs]))
    docs = [(d[0], t, *d[2:]) for d, t in zip(docs, left) if t is not None or d[1] is None]
    gone = {i for i, k in brute.near_groups([(d[0], d[1]) for d in docs]).items() if i != k}
    docs = [d for d in docs if d[0] not in gone]
    kept = brute.mix([(d[0], d[3], brute.n_words(d[1])) for d in docs])
    docs = [docs[r] for r, _ in kept]
    want = brute.pack([(d[0], d[3], brute.n_words(d[1])) for d in docs], packing.WINDOW_TOKENS)
    got = [tuple(r) for r in pipeline.run(spark, SMALL).collect()]
    assert Counter(got) == Counter(want) and want


def test_stages_keep_the_columns_and_take_awkward_tables(spark, docs, rows, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([(0, 1, 0), (3, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs.select(columns), docs.select(columns).limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == columns
            if table is not docs:
                out.count()
        assert pipeline.STAGES[-1][1](spark, table, str(tmp_path)).columns == ["window_id", "window_pos", "doc_id", "source", "doc_start", "n_tokens"]


def test_run_over_a_folder(spark, docs, rows, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_no_near_duplicate_is_missed(spark, monkeypatch):
    """Of 600 pairs of hashes that differ in as many bits as may be, one each stays; so of a chain; strangers stay."""
    rng = brute.np.random.default_rng(11)
    change = lambda a, d: a ^ brute.np.isin(brute.np.arange(simhash.BITS), rng.choice(simhash.BITS, d, replace=False))
    sigs = []
    for _ in range(600):
        a = rng.integers(0, 2, simhash.BITS)
        sigs += [a, change(a, simhash.BUDGET)]
    chain = [rng.integers(0, 2, simhash.BITS)]
    while len(chain) < 30:
        chain.append(change(chain[-1], 35))
    far = [rng.integers(0, 2, simhash.BITS)]
    far.append(change(far[0], simhash.BUDGET + 1))
    data = [(i, bytes(brute.np.packbits(x).tolist())) for i, x in enumerate([*sigs, *chain, *far])]
    hashes = spark.createDataFrame(data, "id long, sig binary")
    monkeypatch.setattr(simhash, "signatures", lambda docs, **_: hashes)
    docs = spark.createDataFrame([(i, "x") for i, _ in data], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in pipeline.near_duplicates_out(spark, docs, "").collect())
    assert kept == [*range(0, 1200, 2), 1200, 1230, 1231]


def test_links_for_other_budgets():
    """links() against all pairs, also with few wide segments and with long ranges of rows of one label."""
    rng = brute.np.random.default_rng(3)
    a = rng.integers(0, 2, (1, simhash.BITS)) ^ (rng.random((400, simhash.BITS)) < rng.choice([0.005, 0.03, 0.1, 0.3], (400, 1)))
    words = brute.np.packbits(a.astype(brute.np.uint8), axis=1).view(brute.np.uint64)
    label = brute.np.where(rng.random(400) < 0.4, 0, brute.np.arange(400))
    far = brute.np.bitwise_count(words[:, None] ^ words[None]).sum(2)
    for budget in (0, 1, 5, 20, 36, 60):
        want = {(int(label[i]), int(label[j])) for i, j in zip(*brute.np.nonzero(far <= budget)) if label[i] != label[j]}
        assert simhash.links(words, label, words, label, budget) == want and (budget < 20 or want)
        ends = [(a, r) for a, _, r in simhash.segments(budget)]
        assert sum(r + 1 for _, r in ends) == budget + 1
