"""Chat formatting by incremental rendering of a template that is a black box.

A template is any function from a list of messages to a string. A conversation's prefixes are rendered one turn longer
each time and every output is compared with the one before. If the new output is the old one with something inserted
(at its end, or before a closing tail that the template always writes), the insertion is the turn's span. If not, the
template rewrote history: the turn is marked, with the place from which the outputs differ, and the turns whose spans
reach past that place are no longer stable. Nothing about the template is assumed but that it is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import per_batch

Message = dict[str, str]
Template = Callable[[Sequence[Message]], str]


def chatml(messages: Sequence[Message]) -> str:
    """Every turn between a start mark with its role and an end mark."""
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)


def last_reply(messages: Sequence[Message]) -> str:
    """As chatml, but of the assistant's turns before the last message only the first line is kept: it rewrites history."""
    n = len(messages) - 1
    return chatml([m if i == n or m["role"] != "assistant" else m | {"content": m["content"].split("\n")[0]} for i, m in enumerate(messages)])


TEMPLATES: dict[str, Template] = {"chatml": chatml, "last_reply": last_reply}


class Turn(NamedTuple):
    begin: int | None  # in the output of the prefix that ends with this turn; null if the turn rewrote history
    end: int | None
    rewrite_from: int | None  # where that output leaves the one before
    stable: bool  # the span holds in the whole conversation's output too
    piece: str | None


def common_prefix(a: str, b: str) -> int:
    """How many characters the two begin with alike."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def common_suffix(a: str, b: str) -> int:
    """How many characters the two end with alike."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def turns(messages: Sequence[Message], template: Template) -> tuple[list[Turn], str]:
    """Every turn's span, and the output of all of them. No messages give no turns and an empty output.

    Of the outputs only the last and the end that all share are held, and of each new one what may be its turn's.
    """
    if not messages:
        return [], ""
    try:
        before, checked = template([]), True
    except Exception:  # a template may refuse to render nothing; then the head counts to the first turn
        before, checked = "", False
    shared = before if checked else None
    rests, steps = [0], []
    for k in range(len(messages)):
        new = template(messages[: k + 1])
        p = common_prefix(before, new)
        if checked:
            rests.append(len(before) - p)
        shared = new if shared is None else shared[len(shared) - common_suffix(shared, new) :]
        since = max(0, len(before) - len(shared)) if checked else 0
        steps.append((len(before), checked, len(new), p, since, new[since:]))
        before, checked = new, True
    # A tail is what every output ends with and every new turn stands before: the longest rest of an old output.
    tail = max(n for n in rests if n <= len(shared))
    out: list[Turn] = []
    lowest = len(before)  # the least place that a later turn rewrote
    for old, known, n, p, since, held in reversed(steps):
        begin, end = old - (tail if known else 0), n - tail
        if p >= begin and end >= begin:
            out.append(Turn(begin, end, None, end <= lowest, held[begin - since : end - since]))
        else:
            out.append(Turn(None, None, p, False, None))
            lowest = min(lowest, p)
    return out[::-1], before


def format_chats(
    messages: DataFrame,
    templates: Sequence[str] | dict[str, Template] = ("chatml",),
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(template, conv_id, turn, role, span_begin, span_end, rewrite_from, stable, piece): a row for every message.

    Turns are in the order of their numbers (null first), ties by role and then text; repeated rows are turns each. Null
    roles and texts render as empty; a null conversation is one of its own. Texts are rendered whole, however long; a
    conversation is one row of a task, as its template sees it. The pieces of a conversation that no turn rewrote, put
    together, are its output (but for a head or tail that belongs to no turn). An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    chosen = templates if isinstance(templates, dict) else {t: TEMPLATES[t] for t in templates}
    kind, n_kind = (messages.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    part = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = messages.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            row, cols = [], [[] for _ in range(8)]
            for r, parts in enumerate(b.column(1).to_pylist()):
                given = [{"role": m["role"], "content": m["text"]} for m in parts]
                for name, template in chosen.items():
                    for m, t in zip(parts, turns(given, template)[0]):
                        row.append(r)
                        for c, v in zip(cols, (name, m["turn"], m["role"], t.begin, t.end, t.rewrite_from, t.stable, t.piece)):
                            c.append(v)
            turn_type = b.column(1).type.value_type.field("turn").type
            kinds = (pa.string(), turn_type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            name, *rest = (pa.array(c, k) for c, k in zip(cols, kinds))
            return pa.RecordBatch.from_arrays([name, b.column(0).take(pa.array(row, pa.int64())), *rest], names=["template", "conv_id", "turn", "role", "span_begin", "span_end", "rewrite_from", "stable", "piece"])

        return run

    return per_batch(whole, ["conv_id", "parts"], make, f"template string, conv_id {kind}, turn {n_kind}, role string, span_begin long, span_end long, rewrite_from long, stable boolean, piece string")


def op9(spark, sf_dir: str) -> DataFrame:
    """Every message of every conversation in two templates, of which the second rewrites history."""
    return format_chats(common.table(spark, sf_dir, "conversations"), tuple(TEMPLATES))


#: chatml appends, so spans are running sums. last_reply rewrites where the message before was an assistant's of several lines.
OP9_SQL = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
  FROM conversations),
r AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece,
         length(role) + 24 + CASE WHEN role = 'assistant' THEN length(split_part(text, chr(10), 1)) ELSE length(text) END AS short,
         role = 'assistant' AND strpos(text, chr(10)) > 0 AS cut
  FROM m),
s AS (
  SELECT *, CAST(sum(length(piece)) OVER w AS BIGINT) - length(piece) AS b1, CAST(sum(short) OVER w AS BIGINT) - short AS b2,
         coalesce(lag(cut) OVER w2, false) AS rewrites, lead(k) OVER w2 IS NOT NULL AS followed
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY conv_id ORDER BY k)),
t AS (
  SELECT *, lag(b2 + length(role) + 13 + length(split_part(text, chr(10), 1))) OVER (PARTITION BY conv_id ORDER BY k) AS differs FROM s)
SELECT 'chatml' AS template, conv_id, turn, role, b1 AS span_begin, b1 + length(piece) AS span_end,
       CAST(NULL AS BIGINT) AS rewrite_from, true AS stable, piece FROM s
UNION ALL
SELECT 'last_reply', conv_id, turn, role, CASE WHEN NOT rewrites THEN b2 END, CASE WHEN NOT rewrites THEN b2 + length(piece) END,
       CASE WHEN rewrites THEN differs END, NOT rewrites AND NOT (cut AND followed), CASE WHEN NOT rewrites THEN piece END
FROM t
"""
