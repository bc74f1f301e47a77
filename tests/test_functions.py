"""Message, vector, schema and cost columns on small cases."""

import base64
import json
import math
import os
from typing import Optional

import pytest
from pydantic import BaseModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import cost, messages, schema, vectors
from sparkloom.functions.accessor import ai
from sparkloom.operators import ann
from sparkloom.operators.knn import gather, knn_join, knn_positions


def msg(role, content):
    return dict(role=role, content=content)


def axis(k, n=3):
    """A unit vector."""
    return [float(i == k) for i in range(n)]


def one(df):
    return [r[0] for r in df.collect()]


def test_to_message(spark):
    df = spark.createDataFrame([("Hello, world!",), ('quo"te \\ back\nline é \x1b',), (None,), ("",)], "t string")
    out = one(df.select(messages.string_to_message("t")))
    assert json.loads(out[0]) == msg("user", "Hello, world!")
    assert out[0] == json.dumps(msg("user", "Hello, world!"))
    assert json.loads(out[1])["content"] == 'quo"te \\ back\nline é \x1b'
    assert out[2] is None and json.loads(out[3])["content"] == ""


@pytest.mark.parametrize(
    "cells,expected",
    [
        ([json.dumps(msg("user", "a")), json.dumps(msg("assistant", "b"))], [msg("user", "a"), msg("assistant", "b")]),
        (['[{"a": 1}, {"a": 2}]', '{"a": 3}'], [{"a": 1}, {"a": 2}, {"a": 3}]),
        ([None, ""], []),
        (['{"a": 1}', "[]"], [{"a": 1}]),
        (["[]", '{"a": 1}'], [{"a": 1}]),
        (["42", '"hi"'], [42, "hi"]),
        (['say "x" \\ and\nline'], [msg("user", 'say "x" \\ and\nline')]),
    ],
)
def test_combine_messages(spark, cells, expected):
    names = [f"c{i}" for i in range(len(cells))]
    df = spark.createDataFrame([tuple(cells)], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    assert json.loads(one(df.select(messages.combine_messages(*names)))[0]) == expected


def test_combine_needs_columns():
    with pytest.raises(ValueError):
        messages.combine_messages()


def test_conversation_and_template(spark):
    df = spark.createDataFrame([(2, "assistant", "b"), (1, "user", "a"), (3, "user", None)], "n int, role string, text string")
    assert json.loads(one(df.agg(messages.conversation("n", "role", "text")))[0]) == [msg("user", "a"), msg("assistant", "b")]
    assert one(df.filter("n < 3").orderBy("n").select(messages.template("{{{}}} {role} {0}", "text", role="role"))) == ["{a} user a", "{b} assistant b"]
    assert one(df.filter("n = 3").select(messages.template("x {}", "text"))) == [None]


VECTORS = "a array<double>, b array<double>"


def test_similarity(spark):
    df = spark.createDataFrame([(axis(0), axis(0)), (axis(0), axis(1)), ([2.0, 4.0, 6.0], [1.0, 2.0, 3.0]), ([3.0, 4.0, 0.0], [0.0, 0.0, 0.0]), ([], []), (None, [0.0]), ([1.0, None, 2.0], [2.0, 5.0, 1.0])], VECTORS)
    got = df.select(vectors.cosine_similarity("a", "b"), vectors.dot_product("a", "b"), ai("a").euclidean_distance("b")).collect()
    want = [(1, 1, 0), (0, 0, math.sqrt(2)), (1, 28, math.sqrt(14)), (0, 0, 5), (0, 0, 0), (None, None, None), (4 / 5, 4, math.sqrt(2))]
    for g, w in zip(got, want):
        assert tuple(g) == pytest.approx(w, abs=1e-9) if w[0] is not None else tuple(g) == w


def test_packed_vectors(spark):
    rows = [(axis(0), axis(1)), ([2.0, 4.0, 6.0], [1.0, 2.0, 3.0]), (None, [0.0]), ([], []), ([0.5] * 700, [0.25] * 700), (None, None)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    packed = df.select("a", "b", vectors.packed("a").alias("x"), vectors.packed("b").alias("y"))
    for f in (vectors.cosine_similarity, vectors.dot_product, vectors.euclidean_distance):
        for r in packed.select(f("a", "b").alias("u"), f("x", "y").alias("v"), f("x", "b").alias("w")).collect():
            assert r["u"] is None and r["v"] is None and r["w"] is None or r["v"] == pytest.approx(r["u"], abs=1e-6) == r["w"]
    with pytest.raises(Exception, match="32-bit"):
        spark.createDataFrame([(bytearray(b"abc"),)], "a binary").select(vectors.dot_product("a", "a")).collect()
    assert one(spark.createDataFrame([([1.0, 2.0],)], "v array<float>").select(vectors.packed("v"))) == [b"\0\0\x80?\0\0\0@"]


def test_unequal_lengths_fail(spark):
    df = spark.createDataFrame([(axis(0), [1.0, 0.0])], VECTORS)
    with pytest.raises(Exception, match="same length"):
        df.select(vectors.cosine_similarity("a", "b")).collect()


def test_literal_query_and_floats(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],)], "v array<float>")
    assert one(df.select(vectors.cosine_similarity([0.0, 1.0], "v"))) == [0.0, 1.0]


def test_knn_positions(spark):
    corpus = [axis(0), [0.9, 0.1, 0.0], None, axis(1), axis(2)]
    df = spark.createDataFrame([(axis(0), corpus), (axis(1), corpus), (None, corpus), (axis(0), [])], "q array<double>, c array<array<double>>")
    assert one(df.select(knn_positions("q", "c", k=2))) == [[0, 1], [3, 1], None, []]
    assert one(df.limit(1).select(ai("q").knn("c", k=9))) == [[0, 1, 3, 4]]
    assert one(df.limit(1).select(knn_positions("q", "c", k=0))) == [[]]


def test_knn_join_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(100, None), (None, [1.0] * 4), (101, [1.0] * 4), (102, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)

    def cos(x, y):
        n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
        return round(sum(a * b for a, b in zip(x, y)) / n, 9) if n else 0.0

    held = {i: v for i, v in rows if i is not None and v is not None}
    want = {i: [j for _, j in sorted((-cos(v, w), j) for j, w in held.items() if j != i)[:7]] for i, v in held.items()}
    got = {}
    found = knn_join(df, df, 7, exclude_same_id=True)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got == want
    assert gather(df, found).count() == found.count()
    assert knn_join(df, df.limit(0), 3).count() == 0 and knn_join(df, df, 0).count() == 0


def test_index_against_exact_search(spark):
    """Recall of at least 0.95 on vectors in clusters and on vectors that lie anywhere; all found by full probes."""
    import numpy as np

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 24))
    clustered = middle[rng.integers(30, size=1500)] + 0.3 * rng.normal(size=(1500, 24))
    for x in (clustered, rng.normal(size=(1200, 24))):
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 24), (9000, None), (9001, [1.0, 2.0]), (9002, [1.0, 2.5]), (9003, [])]
        df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
        pairs = lambda found: {tuple(r) for r in found.select("query_id", "neighbor_id", "rank", "distance").collect()}
        exact = pairs(knn_join(df, df, 5, exclude_same_id=True))
        near = {p[:2] for p in pairs(ann.knn_approx(df, df, 5, exclude_same_id=True))}
        assert len(near & {p[:2] for p in exact}) / len(exact) >= 0.95
        assert pairs(ann.knn_approx(df, df, 5, cells=7, probes=7, exclude_same_id=True)) == exact
        assert (9001, 9002) in near


def test_index_splits_large_cells(spark, monkeypatch):
    """All rows in one cell, of which no task gets more than its share; no row is lost or met twice."""
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    monkeypatch.setattr(ann, "CELL_QUERIES", 30)
    df = spark.createDataFrame([(i, [1.0, 1.0 + i / 1000]) for i in range(300)], "id long, embedding array<float>").repartition(8)
    found = ann.knn_approx(df, df, 3, cells=1)
    assert sorted(map(tuple, found.select("query_id", "neighbor_id", "rank").collect())) == sorted(map(tuple, knn_join(df, df, 3).select("query_id", "neighbor_id", "rank").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "BroadcastHashJoin" not in plan
    assert ann.knn_approx(df, df.limit(0), 3).count() == 0 and ann.knn_approx(df.limit(0), df, 3).count() == 0 and ann.knn_approx(df, df, 0).count() == 0
    with pytest.raises(ValueError):
        ann.knn_approx(df, df, -1)


def test_index_sends_a_query_once_to_a_column(spark):
    """However many cells of a column a query asks for, its vector is sent there once."""
    import numpy as np

    x = np.random.default_rng(2).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    centres = ann.fit(x, 20)
    at, cells = ann.columns_of(ann._counts(df, centres, 1), 150)
    assert 3 <= len(cells) <= 5 and sum(map(len, cells)) == len(at) > 15
    sent = ann._queries(df, centres, 20, cells, 2).selectExpr("sum(size(ids)) n").first()["n"]
    assert sent == 400 * len(cells)


def test_squares_compare_few_exactly():
    """Most pairs are left out by the product of 32-bit floats; ties, equal ids and vectors that are no numbers are as by brute force."""
    import numpy as np
    import pyarrow as pa

    from sparkloom.operators.knn import Nearest, _unit

    rng = np.random.default_rng(1)
    x = _unit(np.concatenate([rng.normal(size=(3000, 16)), np.repeat(rng.normal(size=(3, 16)), 20, axis=0), np.zeros((4, 16))]))
    x[7] = np.nan
    ids = rng.permutation(len(x)) // 2
    best = Nearest(pa.array(ids[:300]), x[:300], pa.array(ids), x, 4, True)
    exactly, add = [], best._add
    best._add = lambda held: (exactly.extend(len(i) for i, _ in held), add(held))
    best.compare(np.arange(300), np.arange(len(x)))
    assert sum(exactly) < 0.05 * 300 * len(x)
    got = {}
    for q, c, sim in zip(*(c.to_pylist() for c in best.found().columns)):
        got.setdefault(q, []).append((-sim, c))
    want = {}
    for i in range(300):
        near = [(-s, int(c)) for s, c in zip(np.round(x @ x[i], 9), ids) if np.isfinite(s) and c != ids[i]]
        want.setdefault(int(ids[i]), []).extend(sorted(near)[:4])
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}

class Optionals(BaseModel):
    required: str
    text: Optional[str] = None
    whole: Optional[int] = None
    real: Optional[float] = None
    flag: Optional[bool] = None
    tags: Optional[list[str]] = None
    free: dict[str, str]


def test_schema_types():
    name, s = schema.model_schema(Optionals)
    t = schema.response_type(s)
    assert name == "Optionals" and [f.name for f in t.fields][-3:] == ["_error", "_details", "_raw"]
    assert {f.name: f.dataType.simpleString() for f in t.fields[:-3]} == {"required": "string", "text": "string", "whole": "bigint", "real": "double", "flag": "boolean", "tags": "array<string>", "free": "string"}
    assert s["additionalProperties"] is False


def test_schema_references():
    s = {"type": "object", "properties": {"e": {"$ref": "#/$defs/E"}, "n": {"anyOf": [{"$ref": "#/$defs/N"}, {"type": "null"}]}, "l": {"type": "array"}, "x": {"type": ["null", "integer"]}}, "$defs": {"E": {"enum": ["a"], "type": "string"}, "N": {"type": "object", "properties": {"again": {"$ref": "#/$defs/N"}, "v": {"type": "number"}}}}}
    assert schema.spark_type(s, s).simpleString() == "struct<e:string,n:struct<again:string,v:double>,l:array<string>,x:bigint>"


class Defaults(BaseModel):
    amount: float
    code: str = "USD"


def test_defaults_warn():
    with pytest.warns(UserWarning, match="default value"):
        schema.model_schema(Defaults)


def test_violations():
    _, s = schema.model_schema(Optionals)
    good = {"required": "x", "free": {"a": "b"}}
    assert schema.violations(good, s) == []
    assert schema.violations(good | {"whole": 1.5}, s) and schema.violations(good | {"other": 1}, s) and schema.violations({"free": {}}, s)
    assert schema.violations(good | {"free": {"a": 1}}, s) and schema.violations(True, {"type": "integer"})
    assert schema.violations(1.2, {"type": "number", "maximum": 1}) and not schema.violations(1, {"type": "number", "maximum": 1})


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def slow_tokens(text, ranks):
    """Byte-pair merges one at a time, the least rank first."""
    import regex

    n = 0
    for piece in regex.findall(cost.SPLIT, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not known:
                break
            _, i = min(known)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        n += len(parts)
    return n


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")
def test_tokens_and_their_cost_by_brute_force(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()[:25]] + ["", " ", "naïve café \U0001f600 12,345.67\n\n\ttab", "aaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    make = cost.rank_tokenizer(RANKS)
    got = {r[0]: r[1:] for r in df.select("i", cost.count_tokens("t", tokenizer=make), cost.input_cost("t", model="gpt-4o", tokenizer=make)).collect()}
    want = {i: slow_tokens(t, ranks) for i, t in enumerate(texts)}
    assert {i: n for i, (n, _) in got.items()} == want | {99: None}
    assert all(got[i][1] == pytest.approx(n * 2.5 / 1e6, abs=1e-15) for i, n in want.items()) and got[99][1] is None


def test_cost(spark):
    df = spark.createDataFrame([(1000,), (None,)], "n long")
    assert one(df.select(cost.cost_from_tokens("n"))) == [pytest.approx(0.01), None]
    assert one(df.select(cost.cost_from_tokens("n", output=True))) == [pytest.approx(0.03), None]
    assert one(df.select(cost.cost_from_tokens("n", model="none"))) == [None, None]
    assert len(cost.PRICES) == 68 and cost.price("OpenAI", "gpt-4o-mini") == (0.15, 0.6)
    assert {cost.encoding_name(m) for m in ("gpt-4o", "GPT-4o-mini", "o1-preview")} == {"o200k_base"} and {cost.encoding_name(m) for m in ("gpt-4", "claude-3-opus")} == {"cl100k_base"}
    words = df.select(F.when(F.col("n") > 0, F.lit("Hello, world!")).alias("t"))
    assert one(words.select(cost.count_tokens("t", tokenizer=lambda: lambda t: len(t.split())))) == [2, None]
    assert one(words.select(cost.input_cost("t", tokenizer=lambda: lambda t: 10**6))) == [10.0, None]
