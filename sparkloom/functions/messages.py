"""Chat messages and conversations as JSON strings, built by Catalyst expressions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import to_col


def json_text(x: Column) -> Column:
    """A string as a JSON string with its quotes; null stays null."""
    # {"c":"..."}: what stands after the colon, less the closing brace.
    whole = F.to_json(F.struct(x.alias("c")))
    return F.when(x.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def string_to_message(content, *, message_type: str = "user") -> Column:
    """``{"role": "<type>", "content": "<text>"}``; null for null. Any role is taken as it is."""
    return F.concat(F.lit('{"role": "' + message_type + '", "content": '), json_text(to_col(content)), F.lit("}"))


def combine_messages(*cells) -> Column:
    """One JSON array of the messages and arrays in the cells, in their order; null and empty cells are passed over.

    A cell in brackets gives its elements, one in braces or any other JSON itself, and other text becomes a user's
    message. The result is never null: without messages it is ``[]``.
    """
    if not cells:
        raise ValueError("combine_messages needs a column at least")

    def part(x: Column) -> Column:
        return (
            F.when(x.startswith("[") & x.endswith("]"), F.substring(x, F.lit(2), F.length(x) - 2))
            .when(x.startswith("{") & x.endswith("}"), x)
            .when(F.try_parse_json(x).isNotNull(), x)
            .otherwise(string_to_message(x))
        )

    parts = F.array(*(F.when(F.length(c) > 0, part(c)) for c in map(to_col, cells)))
    return F.concat(F.lit("["), F.array_join(F.filter(parts, lambda p: F.length(p) > 0), ","), F.lit("]"))


def conversation(order, role, content) -> Column:
    """An aggregate: a group's messages as one JSON array, by ``order``. Null contents are left out."""
    message = F.concat(F.lit('{"role": '), json_text(to_col(role)), F.lit(', "content": '), json_text(to_col(content)), F.lit("}"))
    rows = F.sort_array(F.collect_list(F.when(message.isNotNull(), F.struct(to_col(order).alias("o"), message.alias("m")))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["m"]), ","), F.lit("]"))


def template(pattern: str, *args, **kwargs) -> Column:
    """``pattern`` with ``{}``, ``{0}`` and ``{name}`` replaced by columns; null if any of them is. ``{{`` is a brace."""
    parts, n = [], 0
    for text, name, spec, conversion in string.Formatter().parse(pattern):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError("a template has no formats: " + pattern)
        if name == "":
            name, n = str(n), n + 1
        value = args[int(name)] if name.isdigit() else kwargs[name]
        parts.append(to_col(value).cast("string"))
    return F.concat(*parts) if parts else F.lit("")
