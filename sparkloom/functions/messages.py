"""Native chat messages (role, content, tool_calls, reasoning_content, name, tool_call_id, stop_reason): rendering,
canonical JSON, token windows and training rows. tool_calls is JSON text; null means none."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from sparkloom.functions.jsontext import dumped, members, quoted
from sparkloom.functions.text import strip, truncate

ROLES = ("user", "assistant", "tool", "system")


def _text(name: str) -> Column:
    return F.nullif(strip(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(""))


def stop_reason(raw: Column) -> Column:
    """A turn's stop reason without white space; null if blank."""
    return F.nullif(strip(raw), F.lit(""))


def body() -> Column:
    """What is shown of a message: null if nothing, but an empty tool message stays as empty text."""
    header = F.concat_ws(", ", F.concat(F.lit("name="), _text("name")), F.concat(F.lit("id="), _text("tool_call_id")))
    head = F.when(header != "", F.concat(F.lit("("), header, F.lit(")")))
    tool = F.concat_ws("\n", head, _text("content"))
    assistant = F.nullif(
        F.concat_ws("\n\n", F.concat(F.lit("[reasoning]\n"), _text("reasoning_content")), F.concat(F.lit("[tool_calls]\n"), _text("tool_calls")), _text("content")), F.lit("")
    )
    return F.when(F.col("role") == "tool", tool).when(F.col("role") == "assistant", assistant).when(F.col("role").isin("user", "system"), _text("content"))


def canonical() -> Column:
    """A message's canonical JSON: keys in the alphabet's order, texts without white space at their ends, but a tool's
    content as it is. An assistant always has tool_calls (null if none) and has stop_reason only where there is one."""
    own = lambda name: quoted(strip(F.coalesce(F.col(name), F.lit(""))))
    role = quoted(F.col("role"))
    stop = stop_reason(F.col("stop_reason"))
    assistant = members(
        content=own("content"), reasoning_content=own("reasoning_content"), role=role, stop_reason=F.when(stop.isNotNull(), quoted(stop)),
        tool_calls=F.coalesce(dumped(F.col("tool_calls"), sort_keys=True), F.lit("null")),
    )
    tool = members(content=quoted(F.coalesce("content", F.lit(""))), name=own("name"), role=role, tool_call_id=own("tool_call_id"))
    said = members(content=own("content"), role=role)
    return F.when(F.col("role") == "assistant", assistant).when(F.col("role") == "tool", tool).when(F.col("role").isin("user", "system"), said).otherwise(members(role=role))


def canonical_list(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, canonical): one JSON list of the canonical messages of each key in order."""
    ordered = F.array_sort(F.collect_list(F.struct("msg_idx", canonical().alias("c"))))
    return rows.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda e: e["c"]), ", "), F.lit("]")).alias("canonical"))


def fingerprint(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, fingerprint): the first 16 hex digits of SHA-256 over the canonical list."""
    return canonical_list(rows, key).select(*key, F.substring(F.sha2("canonical", 256), 1, 16).alias("fingerprint"))


def rendered_calls(calls: Column) -> Column:
    """tool_calls as the text that chat templates put for them: a function element with one parameter element an
    argument. Arguments that are no JSON stand under the name _raw; those that are no object are left out."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        plain = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

        def element(call: dict) -> str:
            function = call.get("function") or {}
            given = function.get("arguments", "{}")
            try:
                given = json.loads(given) if isinstance(given, str) else given
            except ValueError:
                given = {"_raw": given}
            named = given.items() if isinstance(given, dict) else ()
            inner = "".join(f"<parameter={k}>\n{plain(v)}\n</parameter>\n" for k, v in named)
            return f"<tool_call>\n<function={function.get('name', '')}>\n{inner}</function>\n</tool_call>"

        def whole(t: str) -> str:
            listed = json.loads(t)
            return "\n".join(element(c) for c in listed if isinstance(c, dict)) if isinstance(listed, list) else ""

        return pa.array([None if t is None else whole(t) for t in column.to_pylist()], pa.string())

    return run(calls)


def training_message() -> Column:
    """struct<role, content, reasoning_content> of a message, an assistant's tool calls rendered at its content's end."""
    said = F.coalesce("content", F.lit(""))
    calls = F.when((F.col("role") == "assistant") & ~F.coalesce("tool_calls", F.lit("null")).isin("null", "[]"), rendered_calls(F.col("tool_calls")))
    content = F.when(calls.isNull(), said).when(strip(said) == "", calls).otherwise(F.concat(said, F.lit("\n\n"), calls))
    reasoning = F.when(F.col("role") == "assistant", F.nullif("reasoning_content", F.lit("")))
    return F.struct(F.col("role"), content.alias("content"), reasoning.alias("reasoning_content"))


def _collected(rows: DataFrame, key: list[str], line: Column) -> DataFrame:
    """One text a session, which is what is asked for."""
    lines = F.array_sort(F.collect_list(F.struct("msg_idx", line.alias("l"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(lines, lambda e: e["l"]), "\n").alias("text"))


def joined(rows: DataFrame, key: list[str]) -> DataFrame:
    """[role]: body lines of each session in order; empty bodies and other roles are left out."""
    some = rows.where(F.col("role").isin(*ROLES) & (F.col("body") != ""))
    return _collected(some, key, F.concat(F.lit("["), "role", F.lit("]: "), "body"))


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """[i] [role]: body lines of each session, numbered from 1."""
    some = rows.where("body IS NOT NULL").withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy("msg_idx")))
    return _collected(some, key, F.concat(F.lit("["), F.col("__i"), F.lit("] ["), "role", F.lit("]: "), "body"))


def windows(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, msg_idx, role, text, window) of rows that have a body: greedy chunks, numbered from 0, of consecutive
    messages under `most` tokens (at least 256), a token being a character. A message over the budget is cut and
    stands alone.

    Each choice depends on those before it in its session, so a session is one task's work, but its rows only
    stream through in order: nothing of a session is held but the size of the chunk that is open.
    """
    most = max(256, int(most)) if most and most > 0 else 65536
    some = rows.where(F.col("role").isin(*ROLES) & (F.col("body") != ""))
    line = F.length("role") + F.length("body") + 4  # "[role]: " without the body, and the body
    cut = truncate(F.col("body"), F.greatest(F.lit(1), F.lit(most) - F.length("role") - 4))
    text = F.when(line > most, F.when(strip(cut) == "", F.lit(" ")).otherwise(cut)).otherwise(F.col("body"))
    sized = some.select(*key, "msg_idx", "role", text.alias("text"), line.cast("long").alias("n"))
    ordered = sized.repartition(*key).sortWithinPartitions(*key, "msg_idx")
    keys = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, window, used = None, -1, most
        for batch in batches:
            out = []
            names = zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True)
            for name, n in zip(names, batch.column(keys + 3).to_pylist(), strict=True):
                if name != session:
                    session, window, used = name, -1, most
                # A line break joins a line to those before it; nothing fits beside a message that was cut.
                fits = used + 1 + n <= most
                window += not fits
                used = used + 1 + n if fits else n
                out.append(window)
            yield pa.RecordBatch.from_arrays([*batch.columns[: keys + 3], pa.array(out, pa.int32())], names=[*batch.schema.names[: keys + 3], "window"])

    schema = ordered.drop("n").schema.add("window", IntegerType())
    return ordered.mapInArrow(run, schema)


def within_budget(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, text): [role]: body lines in order while they fit `most` characters, the line that does not is cut,
    and nothing comes after it."""
    some = rows.where(F.col("role").isin(*ROLES) & (F.col("body") != ""))
    n = F.length("role") + F.length("body") + 4
    before = Window.partitionBy(*key).orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    used = some.withColumn("__n", n).withColumn("__used", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    left = F.lit(most) - F.col("__used")
    budget = (left - F.length("role") - 4).cast("int")
    cut = F.when(budget > 0, truncate(F.col("body"), budget))
    line = F.when(F.col("__n") <= left, F.concat(F.lit("["), "role", F.lit("]: "), "body")).when(left > 0, F.concat(F.lit("["), "role", F.lit("]: "), F.nullif(cut, F.lit(""))))
    # Lines after the first that does not fit have used up more than the budget.
    return _collected(used.withColumn("__line", line).where("__line IS NOT NULL"), key, F.col("__line"))
