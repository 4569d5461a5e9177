"""JSON text in the spacing of Python's json module, and JSON values out of noisy replies."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters without a short escape, whose code Spark writes with capital letters.
_CAPITAL = ["0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"]


def quoted(text: Column) -> Column:
    """The text as a JSON string; null is null's literal."""
    whole = F.to_json(F.array(text))
    inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
    small = reduce(lambda t, h: F.regexp_replace(t, rf"(?<!\\)((?:\\\\)*)\\u00{h}", rf"$1\\u00{h.lower()}"), _CAPITAL, inner)
    return F.when(text.rlike("[\x0b\x0e\x0f\x1a-\x1f]"), small).otherwise(inner)


def members(**fields: Column) -> Column:
    """A JSON object of values that are JSON text already, in the order given; null values are left out."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]), F.lit("}"))


def string_map(entries: Column) -> Column:
    """A map<string, string> as a JSON object."""
    pairs = F.transform(F.map_entries(entries), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def dumped(text: Column, sort_keys: bool = False) -> Column:
    """JSON text written anew with a space after each comma and colon; null stays, and text that is no JSON gives null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            try:
                out.append(None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=sort_keys))
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())

    return run(text)


def unfenced(reply: Column) -> Column:
    """What stands in the first fence of a reply, one marked json before others; the whole reply without fences."""
    strip = lambda c: F.trim(c, F.lit(" \t\r\n"))
    inside = lambda mark: strip(F.regexp_extract(reply, f"(?s){mark}(.*?)(?:```|\\z)", 1))
    return F.when(F.contains(reply, F.lit("```json")), inside("```json")).when(F.contains(reply, F.lit("```")), inside("```")).otherwise(strip(reply))


def first_value(text: Column, otherwise: str | None = None) -> Column:
    """The text's JSON value, or the first object or array inside it, as JSON text; `otherwise` if there is none.

    Text before and after the value does not matter. Control characters inside strings are allowed.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        decoder = json.JSONDecoder(strict=False)

        def starts(t: str):
            # The whole text first, then wherever a bracket opens.
            yield lambda: decoder.decode(t)
            for m in re.finditer(r"[\[{]", t):
                yield lambda at=m.start(): decoder.raw_decode(t, at)[0]

        def value(t: str | None) -> str | None:
            for attempt in starts(t or ""):
                try:
                    return json.dumps(attempt(), ensure_ascii=False)
                except (ValueError, RecursionError):
                    continue
            return otherwise

        return pa.array([value(t) for t in column.to_pylist()], pa.string())

    return run(text)


def from_reply(reply: Column, array: bool = True) -> Column:
    """The JSON value of a model's reply as text, [] or {} where it has none."""
    return first_value(unfenced(reply), "[]" if array else "{}")


def object_or_empty(text: Column) -> Column:
    """The text if it is a JSON object, else {}."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), text).otherwise(F.lit("{}"))
