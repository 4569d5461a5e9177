"""Agent session files: JSON lines in two dialects, read and parsed in the JVM with variant values.

A session file has a bounded size (files over the cap are left out), so the lines of one session fit one task.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.config import DEFAULTS
from sparkloom.functions import messages as M
from sparkloom.functions.jsontext import dumped
from sparkloom.functions.text import strip

_ROLES = ["user", "assistant", "tool", "system"]
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
_BLOCKS = ["text", "thinking", "tool_use", "tool_result"]


def is_session_path(path: Column, root: Column | str = "") -> Column:
    """Whether a file below root is a session file: the suffix .jsonl in any case, and no hidden part below root."""
    root = F.lit(root) if isinstance(root, str) else root
    below = F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)
    return F.endswith(F.lower(path), F.lit(".jsonl")) & ~F.concat(F.lit("/"), below).rlike(r"/\.")


def read_files(spark: SparkSession, path: str, cap: int = DEFAULTS.file_cap_bytes) -> DataFrame:
    """(session, size, text) of every session file below path that is not over the cap; bad UTF-8 is replaced.

    Files over the cap keep a row with a null text, so that they can be reported; their content is not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").option("recursiveFileLookup", "true").load(path)
    shown = files.where(is_session_path(F.regexp_replace("path", _SCHEME, ""), re.sub(_SCHEME, "", path).rstrip("/")))
    keep = lambda small: shown.where((F.col("length") <= cap) if small else (F.col("length") > cap))
    whole = keep(True).select(F.col("path").alias("session"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return whole.unionByName(keep(False).select(F.col("path").alias("session"), F.col("length").alias("size"), F.lit(None).cast("string").alias("text")))


def ingested(files: DataFrame, agent: Column, known: DataFrame, cap: int = DEFAULTS.file_cap_bytes) -> DataFrame:
    """(agent_id, session_file, success, new_trajectory_count, lines, error) of files(session, size, text).

    A file counts as new if known(agent_id, session_file) lacks it; lines is how far a later extraction has read.
    A file over the cap fails and is not registered.
    """
    own = files.select(agent.alias("agent_id"), F.col("session").alias("session_file"), "size", "text")
    seen = known.select("agent_id", "session_file").distinct().withColumn("__seen", F.lit(True))
    small = F.col("size") <= cap
    clean = strip(F.coalesce("text", F.lit("")))
    return own.join(seen, ["agent_id", "session_file"], "left").select(
        "agent_id",
        "session_file",
        small.alias("success"),
        (small & F.col("__seen").isNull()).cast("int").alias("new_trajectory_count"),
        F.when(small, F.when(clean == "", 0).otherwise(F.size(F.split(clean, "\n")))).alias("lines"),
        F.when(~small, F.concat(F.lit("File too large: "), "session_file")).alias("error"),
    )


def ingest_totals(results: DataFrame) -> DataFrame:
    """One row (total_files, successful, total_memories) of the results of files. A file that succeeded counts with the first of
    memories_uploaded, total_uploaded and new_trajectory_count, as far as results has them, that is neither null nor 0."""
    counters = [c for c in ("memories_uploaded", "total_uploaded", "new_trajectory_count") if c in results.columns]
    first = F.coalesce(*[F.nullif(F.col(c).cast("long"), F.lit(0).cast("long")) for c in counters], F.lit(0).cast("long"))
    return results.agg(F.count(F.lit(1)).alias("total_files"), F.count_if("success").alias("successful"), F.coalesce(F.sum(F.when(F.col("success"), first)), F.lit(0)).alias("total_memories"))


def read_on(files: DataFrame, agent: Column, progress: DataFrame, cap: int = DEFAULTS.file_cap_bytes) -> tuple[DataFrame, DataFrame]:
    """(lines, progress) of files(session, size, text) that were read before up to progress(agent_id, session_file, lines, size).

    lines(agent_id, session_file, line_no, raw) are those behind the last one read; files of the size they had are not looked into.
    The new progress has all files, the old ones' rows where nothing came and for files over the cap. A file that got shorter starts anew.
    """
    own = files.select(agent.alias("agent_id"), F.col("session").alias("session_file"), "size", "text")
    before = progress.select("agent_id", "session_file", F.col("lines").alias("__read"), F.col("size").alias("__size"))
    changed = own.where(F.col("size") <= cap).join(before, ["agent_id", "session_file"], "left").where("__size IS NULL OR __size <> size")
    clean = strip(F.coalesce("text", F.lit("")))
    split = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "\n"))
    at = changed.withColumns({"l": split, "__read": F.when(F.col("size") < F.col("__size"), 0).otherwise(F.coalesce("__read", F.lit(0)))})
    new = F.when(F.size("l") > F.col("__read"), F.slice("l", F.col("__read").cast("int") + 1, F.size("l"))).otherwise(F.array().cast("array<string>"))
    out = at.select("agent_id", "session_file", "__read", F.posexplode(new).alias("p", "raw")).select("agent_id", "session_file", (F.col("__read") + F.col("p") + 1).cast("long").alias("line_no"), "raw")
    now = at.select("agent_id", "session_file", F.size("l").cast("long").alias("lines"), "size")
    same = progress.select("agent_id", "session_file", F.col("lines").cast("long").alias("lines"), "size").join(now, ["agent_id", "session_file"], "left_anti")
    return out, same.unionByName(now)


def lines(texts: DataFrame) -> DataFrame:
    """(session, line_no, raw) of (session, text): lines from 1 in the file's order, the text trimmed."""
    return texts.select("session", F.posexplode(F.split(strip(F.col("text")), "\n")).alias("p", "raw")).select("session", (F.col("p") + 1).cast("long").alias("line_no"), "raw")


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _string(value: Column, path: str) -> Column:
    """The value at the path if it is a string; a cast would write other values as text."""
    return F.when(F.schema_of_variant(_get(value, path, "variant")) == "STRING", _get(value, path))


def _parsed(rows: DataFrame) -> DataFrame:
    """Lines that are not blank with v, role, blocks, and `good`: a JSON object of a known role that is no metadata."""
    out = rows.withColumn("raw", strip(F.col("raw"))).where("raw <> ''").withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    out = out.withColumns({"role": _get(v, "$.role"), "kind": _get(v, "$._type"), "blocks": _get(v, "$.content", "array<variant>")})
    good = v.isNotNull() & F.col("role").isin(_ROLES) & (F.coalesce("kind", F.lit("")) != "metadata")
    return out.withColumn("good", F.coalesce(good, F.lit(False))).drop("kind")


def is_blocks(blocks: Column) -> Column:
    """Whether content is a list of blocks of the four kinds, those of text with a text."""

    def good(b: Column) -> Column:
        t = _get(b, "$.type")
        return F.coalesce(t.isin(_BLOCKS) & ((t != "text") | _get(b, "$.text", "variant").isNotNull()), F.lit(False))

    return F.coalesce((F.size(blocks) > 0) & F.forall(blocks, good), F.lit(False))


def _with_dialect(rows: DataFrame, most: int = 500) -> DataFrame:
    """Parsed lines of repartitioned rows with `split`, whether the line has blocks, and `in_blocks`, whether one of
    its session's first `most` lines that are not blank has."""
    p = _parsed(rows.repartition("session")).withColumn("split", F.col("good") & is_blocks(F.col("blocks")))
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("line_no")))
    return p.withColumn("in_blocks", F.max(F.col("split") & (F.col("n") <= most)).over(Window.partitionBy("session")))


def dialects(rows: DataFrame, most: int = 500) -> DataFrame:
    """(session, dialect): blocks if one of the first `most` lines that are not blank has them, else plain."""
    p = _with_dialect(rows, most).groupBy("session").agg(F.max("in_blocks").alias("b"))
    # Sessions of blank lines alone are plain.
    return rows.select("session").distinct().join(p, "session", "left").select("session", F.when(F.col("b"), "blocks").otherwise("plain").alias("dialect"))


def calls_of_blocks(content: Column) -> Column:
    """tool_calls as JSON text of a content list's tool_use blocks (JSON text), null without any: each becomes a function
    call whose arguments are text, the input's own if it is text."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        def argument(given: object) -> str:
            return given if isinstance(given, str) else json.dumps({} if given is None else given, ensure_ascii=False)

        def calls(t: str | None) -> str | None:
            found = [b for b in json.loads(t or "[]") if b.get("type") == "tool_use"]
            out = [{"id": b.get("id") or "", "type": "function", "function": {"name": b.get("name") or "", "arguments": argument(b.get("input"))}} for b in found]
            return json.dumps(out, ensure_ascii=False) if out else None

        return pa.array([calls(t) for t in column.to_pylist()], pa.string())

    return run(content)


def thoughts(blocks: Column) -> Column:
    """The thinking blocks' texts, blank ones left out."""
    own = F.filter(blocks, lambda b: _get(b, "$.type") == "thinking")
    return F.array_join(F.filter(F.transform(own, lambda b: strip(F.coalesce(_get(b, "$.thinking"), F.lit("")))), lambda t: t != ""), "\n\n")


def said(blocks: Column) -> Column:
    """The text blocks' texts, a line each."""
    own = F.filter(blocks, lambda b: _get(b, "$.type") == "text")
    return strip(F.array_join(F.transform(own, lambda b: F.coalesce(_get(b, "$.text"), F.lit(""))), "\n"))


def told(blocks: Column) -> Column:
    """Texts and thoughts of a system message, a line each."""
    own = F.filter(blocks, lambda b: _get(b, "$.type").isin("text", "thinking"))
    return strip(F.array_join(F.transform(own, lambda b: F.when(_get(b, "$.type") == "text", F.coalesce(_get(b, "$.text"), F.lit(""))).otherwise(F.coalesce(_get(b, "$.thinking"), F.lit("")))), "\n"))


def result_text(text: Column, raw: Column) -> Column:
    """A tool result's content: text as it is, null as empty, anything else (raw JSON) as JSON text."""
    return F.coalesce(text, dumped(F.when(text.isNull() & (raw != "null"), raw)), F.lit(""))


def messages(rows: DataFrame) -> DataFrame:
    """(session, msg_idx, role, content, tool_calls, reasoning_content, name, tool_call_id, stop_reason, body) of lines.

    Lines that are no JSON object, metadata and unknown roles go. In the block dialect a user line can give several
    messages: runs of text, and one for each tool result, in order. Messages that show nothing go, but for tools'.
    tool_calls is JSON text; content that is neither text nor blocks stands as JSON text.

    Lines are dealt by session once and parsed once; everything after works inside a session's rows.
    """
    v, blocks, role = F.col("v"), F.col("blocks"), F.col("role")
    p = _with_dialect(rows).where("good").withColumn("split", F.col("split") & F.col("in_blocks"))
    assistant, tool, split, user = role == "assistant", role == "tool", F.col("split"), role == "user"
    text = lambda path: F.coalesce(_get(v, path), F.lit(""))
    raw = lambda path: F.get_json_object("raw", path)
    own_text = _string(v, "$.content")
    # The raw text is looked at only where content is no string; null and missing content is empty.
    other = F.when(own_text.isNull() & _get(v, "$.content", "variant").isNotNull(), raw("$.content"))
    plain = F.coalesce(own_text, dumped(F.when(other != "null", other)), F.lit(""))
    own_calls = dumped(F.when(assistant & ~split & _get(v, "$.tool_calls", "variant").isNotNull(), raw("$.tool_calls")))
    calls = F.when(assistant & split, calls_of_blocks(F.when(assistant & split, raw("$.content")))).otherwise(F.when(~own_calls.isin("null", "[]"), own_calls))
    whole = p.select(
        "session", "line_no", "role", (split & user).alias("many"),
        F.when(split & assistant, said(blocks)).when(split & (role == "system"), told(blocks)).when(split & user, None).otherwise(plain).alias("content"),
        calls.alias("tool_calls"),
        F.when(assistant & split, thoughts(blocks)).when(assistant, text("$.reasoning_content")).alias("reasoning_content"),
        F.when(tool, text("$.name")).alias("name"),
        F.when(tool, text("$.tool_call_id")).alias("tool_call_id"),
        F.when(assistant, M.stop_reason(_get(v, "$.stop_reason"))).alias("stop_reason"),
        F.when(split & user, blocks).alias("b"),
        F.from_json(F.when(split & user, raw("$.content")), "array<string>").alias("r"),
    )
    each = whole.select("*", F.posexplode_outer(F.arrays_zip("b", "r")).alias("pos", "p")).drop("b", "r").withColumn("t", _get(F.col("p.b"), "$.type"))
    each = each.where("NOT many OR t IN ('text', 'tool_result')")
    # A user's islands of text between tool results.
    is_result = F.coalesce(F.col("t") == "tool_result", F.lit(False))
    line = Window.partitionBy("session", "line_no").orderBy("pos")
    each = each.withColumn("part", F.sum(F.when(is_result, 2).otherwise(0)).over(line) - F.when(is_result, 1).otherwise(0))
    b = F.col("p.b")
    piece = F.when(is_result, result_text(_string(b, "$.content"), F.when(is_result & _string(b, "$.content").isNull(), F.get_json_object("p.r", "$.content")))).otherwise(F.coalesce(_get(b, "$.text"), F.lit("")))
    each = each.withColumns({"piece": F.when(F.col("many"), piece), "use": F.when(is_result, F.coalesce(_get(b, "$.tool_use_id"), F.lit("")))}).drop("p")
    kept = ["role", "content", "tool_calls", "reasoning_content", "name", "tool_call_id", "stop_reason"]
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("many"), F.struct("pos", "piece")))), lambda e: e["piece"])
    merged = each.groupBy("session", "line_no", "part").agg(
        F.bool_or("many").alias("many"), F.max("t").alias("t"), F.max("use").alias("use"), F.array_join(pieces, "\n").alias("joined"), *[F.max(c).alias(c) for c in kept]
    )
    result = F.col("many") & (F.col("t") == "tool_result")
    out = merged.select(
        "session", "line_no", "part",
        F.when(result, "tool").otherwise(F.col("role")).alias("role"),
        F.when(result, F.col("joined")).when(F.col("many"), strip(F.col("joined"))).otherwise(F.col("content")).alias("content"),
        "tool_calls", "reasoning_content", F.when(result, "").otherwise(F.col("name")).alias("name"), F.when(result, F.col("use")).otherwise(F.col("tool_call_id")).alias("tool_call_id"), "stop_reason",
    ).withColumn("body", M.body()).where("body IS NOT NULL")
    order = Window.partitionBy("session").orderBy("line_no", "part")
    return out.withColumn("msg_idx", F.row_number().over(order).cast("long")).drop("line_no", "part")


def slices(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """Messages of each segment(id, session, start_line, end_line): those with start <= msg_idx <= end."""
    return segments.alias("s").join(rows.alias("m"), F.expr("s.session = m.session AND m.msg_idx BETWEEN s.start_line AND s.end_line")).select("s.id", "m.*")
