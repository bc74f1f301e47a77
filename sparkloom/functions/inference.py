"""Calls of language models as Columns.

Each call is an Arrow function over batches that sends a batch's rows through a bounded pool of threads. The functions
are marked nondeterministic, so that Catalyst neither repeats a call nor moves it; filters should therefore stand before
the call. Structured answers are checked in the worker and decoded by ``from_json`` in the JVM.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..sources.providers import Client, Provider, client
from . import schema as S
from .columns import to_col
from .messages import string_to_message

#: Requests of one batch under way at once.
CONCURRENCY = 16
#: Texts, and bytes of them, that are sent on from a batch at once, but as many as there are requests under way in any case.
HELD_ROWS, HELD_BYTES = 512, 1 << 20


def failure(kind: str, details: str, raw: str | None = None) -> str:
    return json.dumps({"_error": kind, "_details": details} | ({} if raw is None else {"_raw": raw}), ensure_ascii=False)


def parse_messages(text: str) -> list[dict[str, str]]:
    """A message or an array of them; anything else is no messages at all."""
    try:
        held = json.loads(text)
    except ValueError:
        return []
    held = [held] if isinstance(held, dict) else held
    fine = isinstance(held, list) and all(isinstance(m, dict) and isinstance(m.get("role"), str) and isinstance(m.get("content"), str) for m in held)
    return [{"role": m["role"], "content": m["content"]} for m in held] if fine else []


def _answer(c: Client, messages: Sequence[dict[str, str]], schema: dict | None, name: str, on_failure: str | None) -> str | None:
    try:
        out = c.complete(messages, schema, name)
    except Exception as e:  # whatever an endpoint does, the row tells of it and the others go on
        if schema is not None:
            return failure("api_error", str(e))
        print(f"model call failed: {e}", file=sys.stderr)
        return on_failure
    if schema is None:
        return out
    try:
        wrong = S.violations(json.loads(out), schema)
    except ValueError as e:
        wrong = [f"not JSON: {e}"]
    return failure("validation_failed", "; ".join(wrong), out) if wrong else out


def _in_turn(values: pa.Array, f: Callable[[str], Any], many: Callable, least: int, kind: pa.DataType) -> pa.Array:
    """``f`` of every text by ``many``, a few texts at a time, so that beside the batch and its answers little is held; null for null."""
    done, lo = [], 0
    ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    while lo < len(values):
        within = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD_BYTES, "right"))
        hi = min(lo + HELD_ROWS, max(lo + least, within), len(values))
        texts = values.slice(lo, hi - lo).to_pylist()
        answers = iter(many(f, [t for t in texts if t is not None]))
        done.append(pa.array([None if t is None else next(answers) for t in texts], kind))
        lo = hi
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _calls(x: Column, f: Callable[[str], Any], kind: str, concurrency: int) -> Column:
    pool: list[ThreadPoolExecutor] = []
    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(values: pa.Array) -> pa.Array:
        if concurrency > 1 and not pool:
            pool.append(ThreadPoolExecutor(concurrency))
        return _in_turn(values, f, pool[0].map if pool else map, max(1, concurrency), arrow)

    # A new object each time: asNondeterministic changes the function it is called on.
    return F.arrow_udf(run, kind).asNondeterministic()(x.cast("string"))


def _infer(x: Column, c: Client, model: Any, to_messages: Callable[[str], list[dict[str, str]]], concurrency: int, on_failure: str | None = None) -> Column:
    name, schema = S.model_schema(model) if model is not None else ("response", None)
    out = _calls(x, lambda text: _answer(c, to_messages(text), schema, name, on_failure), "string", concurrency)
    return out if schema is None else F.from_json(out, S.response_type(schema))


def _user(text: str) -> list[dict[str, str]]:
    return [{"role": "user", "content": text}]


def _client(given: Client | None, provider: Provider | str | None, model: str | None, embeddings: bool = False) -> Client:
    """The client, once it is sure that its key is set: else every row would fail alike."""
    c = given if given is not None else client(provider, model, embeddings=embeddings)
    spark = SparkSession.getActiveSession()
    c.check(lambda name: spark and spark.conf.get(f"spark.executorEnv.{name}", None))
    return c


def inference(prompt, *, provider: Provider | str | None = None, model: str | None = None, response_model: Any = None, response_format: Any = None, client: Client | None = None) -> Column:
    """A model's answer to every prompt, one after the other; null for null, empty where a call fails.

    With a response model the result is a struct of its fields and ``_error``, ``_details`` and ``_raw``.
    """
    return _infer(to_col(prompt), _client(client, provider, model), response_model if response_model is not None else response_format, _user, 1, "")


def inference_async(prompt, *, provider: Provider | str | None = None, model: str | None = None, response_model: Any = None, response_format: Any = None, client: Client | None = None, concurrency: int = CONCURRENCY) -> Column:
    """As ``inference``, with ``concurrency`` calls under way in each task; null where a call fails."""
    return _infer(to_col(prompt), _client(client, provider, model), response_model if response_model is not None else response_format, _user, concurrency)


def inference_messages(messages, *, provider: Provider | str | None = None, model: str | None = None, response_model: Any = None, response_format: Any = None, client: Client | None = None, concurrency: int = CONCURRENCY) -> Column:
    """As ``inference_async`` for conversations: JSON messages or arrays of them."""
    return _infer(to_col(messages), _client(client, provider, model), response_model if response_model is not None else response_format, parse_messages, concurrency)


def embedding(text, *, provider: Provider | str | None = None, model: str | None = None, client: Client | None = None, concurrency: int = CONCURRENCY) -> Column:
    """A text's embedding; null for null and where a call fails."""
    c = _client(client, provider, model, embeddings=True)

    def one(t: str) -> list[float] | None:
        try:
            return c.embed(t)
        except Exception as e:
            print(f"embedding failed: {e}", file=sys.stderr)
            return None

    return _calls(to_col(text), one, "array<double>", concurrency)


def taxonomy_schema(taxonomy: dict[str, dict[str, Any]]) -> dict:
    """The schema of an answer: for every field a thought on each value, a reflection, the value and a confidence from 0 to 1."""
    fields = {}
    for name, field in taxonomy.items():
        values = list(field.get("values", {}))
        fields[name] = {
            "type": "object",
            "description": field.get("description", ""),
            "properties": {
                "thinking": {"type": "object", "additionalProperties": {"type": "string"}, "description": "For each of these values a reason: " + ", ".join(values)},
                "reflection": {"type": "string", "description": "What the reasons come to"},
                "value": {"type": "string", "description": "One of: " + ", ".join(values)},
                "confidence": {"type": "number", "minimum": 0, "maximum": 1},
            },
            "required": ["thinking", "reflection", "value", "confidence"],
        }
    return {"title": "TaxonomyResult", "type": "object", "properties": fields, "required": list(fields)}


def taxonomy_prompt(taxonomy: dict[str, dict[str, Any]]) -> str:
    parts = ["You tag documents. Read the document that follows and choose one value for every field below.", ""]
    for name, field in taxonomy.items():
        parts += [f"Field: {name}", *([field["description"]] if field.get("description") else []), *(f"* {v}: {meaning}" for v, meaning in field.get("values", {}).items()), ""]
    parts += [
        "For every field give, in this order:",
        "thinking: for each value, why it may fit and why not;",
        "reflection: which value the reasons favour;",
        "value: that value, written as above;",
        "confidence: a number from 0 (a guess) to 1 (certain).",
    ]
    return "\n".join(parts)


def tag_taxonomy(document, taxonomy: dict[str, dict[str, Any]], *, provider: Provider | str | None = None, model: str | None = None, client: Client | None = None, concurrency: int = CONCURRENCY) -> Column:
    """A struct with, for every field of the taxonomy, its thinking, reflection, value and confidence. One call a document."""
    x = to_col(document)
    system = json.dumps({"role": "system", "content": taxonomy_prompt(taxonomy)}, ensure_ascii=False)
    messages = F.concat(F.lit("[" + system + ","), string_to_message(x), F.lit("]"))
    return inference_messages(messages, provider=provider, model=model, response_model=taxonomy_schema(taxonomy), client=client, concurrency=concurrency)
