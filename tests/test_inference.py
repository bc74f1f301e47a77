"""Calls of models, against the endpoint in the worker, and what the real ones are sent."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import inference as I
from sparkloom.functions.accessor import ai
from sparkloom.sources import providers as P


def msg(role, content):
    return dict(role=role, content=content)


def one(df):
    return [r[0] for r in df.collect()]


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([("What is 1+1?",), (None,), ("",)], "q string")


def fails(sent, schema):
    raise OSError("no route")


def test_answers_and_failures(questions):
    assert one(questions.select(I.inference("q", client=P.Mock()))) == ["Answer to: What is 1+1?", None, "Answer to: "]
    assert one(questions.select(ai("q").inference_async(client=P.Mock()))) == ["Answer to: What is 1+1?", None, "Answer to: "]
    assert one(questions.select(I.inference("q", client=P.Mock(answer=fails)))) == ["", None, ""]
    assert one(questions.select(I.inference_async("q", client=P.Mock(answer=fails)))) == [None, None, None]
    assert questions.limit(0).select(I.inference_async("q", client=P.Mock())).count() == 0


SCHEMA = {"title": "S", "type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}


def test_structured(questions):
    def answer(sent, schema):
        return '{"n": 4}' if sent[0]["content"] else '{"n": "four"}'

    rows = one(questions.select(I.inference_async("q", client=P.Mock(answer=answer), response_model=SCHEMA)))
    assert rows[0].n == 4 and rows[0]._error is None and rows[1] is None
    assert rows[2].n is None and rows[2]._error == "validation_failed" and rows[2]._raw == '{"n": "four"}'
    down = one(questions.select(I.inference("q", client=P.Mock(answer=fails), response_format=SCHEMA)))
    assert down[0]._error == "api_error" and "no route" in down[0]._details


def test_messages(spark):
    df = spark.createDataFrame([(json.dumps([msg('system', 's'), msg('user', 'u')]),), (json.dumps(msg('user', 'v')),), ("no JSON",), (None,)], "m string")
    heard = P.Mock(answer=lambda sent, schema: json.dumps([m["role"] for m in sent]))
    assert one(df.select(I.inference_messages("m", client=heard))) == ['["system", "user"]', '["user"]', "[]", None]


def test_embedding(questions):
    out = one(questions.select(I.embedding("q", client=P.Mock(vector=lambda t: [float(len(t))]))))
    assert out == [[12.0], None, [0.0]]
    assert len(one(questions.select(I.embedding("q", client=P.Mock())))[0]) == 32


TAXONOMY = {"sentiment": {"description": "The mood", "values": {"good": "Glad", "bad": "Sad"}}}


def test_taxonomy(spark):
    def answer(sent, schema):
        assert sent[0]["role"] == "system" and "* good: Glad" in sent[0]["content"]
        value = "good" if "glad" in sent[1]["content"] else "bad"
        return json.dumps({"sentiment": {"thinking": {"good": "a", "bad": "b"}, "reflection": "r", "value": value, "confidence": 0.9 if value == "good" else 1.2}})

    df = spark.createDataFrame([(1, "I am glad"), (2, "alas"), (3, None)], "id int, d string")
    rows = [r[0] for r in df.orderBy("id").select(I.tag_taxonomy("d", TAXONOMY, client=P.Mock(answer=answer))).collect()]
    assert rows[0].sentiment.value == "good" and json.loads(rows[0].sentiment.thinking) == {"good": "a", "bad": "b"}
    assert rows[1]._error == "validation_failed" and rows[1].sentiment is None and rows[2] is None


def test_one_call_for_each_answer(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("q"))
    x = df.select(I.inference_async("q", client=P.Mock(answer=lambda s, _: '{"n": 1}'), response_model=SCHEMA).alias("r")).filter("r.n = 1").select("r.n", "r._error")
    assert x._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_providers():
    assert P.Provider("OpenAI") is P.Provider.OPENAI
    with pytest.raises(ValueError):
        P.client("nobody")
    with pytest.raises(ValueError):
        P.client("anthropic", embeddings=True)
    assert P.client().model == "gpt-4-turbo" and P.client(embeddings=True).model == "text-embedding-3-small"


SENT = [msg("system", "s"), msg("user", "u"), msg("assistant", "a"), msg("tool", "t"), msg("system", "s2")]


def test_bodies():
    openai = P.client("openai").body(SENT, SCHEMA, "S")
    assert [m["role"] for m in openai["messages"]] == ["system", "user", "assistant", "user", "system"] and openai["response_format"]["json_schema"]["strict"]
    anthropic = P.client("anthropic").body(SENT, SCHEMA, "S")
    assert anthropic["system"] == "s" and [m["role"] for m in anthropic["messages"]] == ["user", "assistant", "user"] and anthropic["tool_choice"]["name"] == "S"
    gemini = P.client("gemini").body(SENT, SCHEMA, "S")
    assert gemini["contents"][0]["parts"][0]["text"] == "System instruction: s" and [c["role"] for c in gemini["contents"]] == ["user", "user", "model", "user"]
    bedrock = P.client("bedrock").body(SENT, None, "S")
    assert bedrock["system"] == [{"text": "s"}] and "toolConfig" not in bedrock


def test_bodies_of_tools_and_schemas():
    groq = P.client("groq").body(SENT, SCHEMA, "S")
    assert [m["role"] for m in groq["messages"]] == ["system", "user", "assistant", "user", "system"] and groq["model"] == "llama3-70b-8192" and groq["response_format"]["json_schema"]["name"] == "S"
    bedrock = P.client("bedrock").body(SENT, SCHEMA, "S")
    assert bedrock["toolConfig"] == {"tools": [{"toolSpec": {"name": "S", "inputSchema": {"json": SCHEMA}}}], "toolChoice": {"tool": {"name": "S"}}}
    used = {"output": {"message": {"content": [{"text": "so"}, {"toolUse": {"input": {"n": 1}}}]}}}
    assert P.client("bedrock").parse(used) == '{"n": 1}'
    how = P.client("gemini").body(SENT, SCHEMA, "S")["generationConfig"]
    assert how["responseJsonSchema"] == SCHEMA and how["responseMimeType"] == "application/json"


def test_embeddings_are_asked_for_and_read(monkeypatch):
    sent = []

    def send(self, url, headers, body):
        sent.append((url, headers, body))
        return {"data": [{"index": 1, "embedding": [9]}, {"index": 0, "embedding": [1, 2.5]}]}

    monkeypatch.setattr(P.OpenAI, "send", send)
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert P.client(embeddings=True).embed("x") == [1.0, 2.5]
    assert sent == [("https://api.openai.com/v1/embeddings", {"Authorization": "Bearer k"}, {"model": "text-embedding-3-small", "input": ["x"], "encoding_format": "float"})]
    with pytest.raises(P.ProviderError):
        P.client("openai", "gpt-4").embed("x")
    with pytest.raises(P.ProviderError):
        P.client("groq").embed("x")


def test_missing_keys_are_told_on_the_driver(questions, monkeypatch):
    for name in ("OPENAI_API_KEY", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "GEMINI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    for f, options in ((I.inference, {}), (I.inference_async, {"provider": "bedrock"}), (I.inference_messages, {"provider": "gemini"}), (I.embedding, {})):
        with pytest.raises(P.ProviderError, match="set neither"):
            f("q", **options)
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    I.inference("q")


def test_answers_are_read():
    assert P.client("groq").parse({"choices": [{"message": {"content": "x"}}]}) == "x"
    assert P.client("anthropic").parse({"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "input": {"n": 1}}]}) == '{"n": 1}'
    assert P.client("gemini").parse({"candidates": [{"content": {"parts": [{"text": "x"}]}}]}) == "x"
    assert P.client("bedrock").parse({"output": {"message": {"content": [{"text": "x"}]}}}) == "x"


def test_keys(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(P.ProviderError, match="OPENAI_API_KEY"):
        P.client("openai").complete(SENT)
    monkeypatch.setenv("AWS_ACCESS_KEY_ID", "AK")
    monkeypatch.setenv("AWS_SECRET_ACCESS_KEY", "SK")
    heads = P.client("bedrock").signed("h", "/p", "us-east-1", b"{}", datetime.datetime(2024, 1, 2, tzinfo=datetime.UTC))
    assert heads["Authorization"].startswith("AWS4-HMAC-SHA256 Credential=AK/20240102/us-east-1/bedrock/aws4_request, SignedHeaders=host;x-amz-date, Signature=")


def test_trying_again(monkeypatch):
    calls = []

    def urlopen(request, timeout):
        calls.append(request)
        raise OSError("down")

    monkeypatch.setattr(P.urllib.request, "urlopen", urlopen)
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    with pytest.raises(P.ProviderError, match="down"):
        P.client("openai", retries=2, wait=0).complete(SENT)
    assert len(calls) == 3


def test_few_texts_of_a_batch_are_held_at_once():
    """However many rows a batch has, and however long they are; nulls and the order of rows stay."""
    import pyarrow as pa

    texts = ["é" * 300_000, None, *(f"t{n}" for n in range(3000)), *("x" * 100_000 for _ in range(40)), None]
    asked = []
    out = I._in_turn(pa.array(texts), str.upper, lambda f, some: asked.append(some) or map(f, some), 4, pa.string())
    assert out.to_pylist() == [None if t is None else t.upper() for t in texts]
    assert max(map(len, asked)) <= I.HELD_ROWS and all(len(some) <= 4 or sum(len(t.encode()) for t in some) <= I.HELD_BYTES for some in asked)
    assert I._in_turn(pa.array([], pa.string()), str.upper, map, 4, pa.string()).to_pylist() == []
    assert I._in_turn(pa.array([None, "a"]).slice(1), lambda t: [1.0], map, 1, pa.list_(pa.float64())).to_pylist() == [[1.0]]
