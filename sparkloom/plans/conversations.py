"""Session files, native messages, canonical JSON, training rows and replies: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import jsontext as JT
from sparkloom.functions import messages as M
from sparkloom.plans.registry import query, strip_sql
from sparkloom.sources import fixtures as X
from sparkloom.sources import sessions as J
from sparkloom.sources.fixtures import ctes

_PATH = "CASE event_id % 6 WHEN 0 THEN '/data/s/' || event_id || '.jsonl' WHEN 1 THEN '/data/s/' || event_id || '.JSONL' WHEN 2 THEN '/data/.old/' || event_id || '.jsonl' WHEN 3 THEN '/data/s/.' || event_id || '.jsonl' WHEN 4 THEN '/data/' || event_id || '.json' ELSE '/data/a/b/' || event_id || '.jsonl' END"


@query(f"SELECT {_PATH} AS path FROM events WHERE event_id % 6 IN (0, 1, 5)")
def src01_session_paths(spark, sf):
    e, n = X.table(spark, sf, "events"), F.col("event_id") % 6
    name = lambda a, b: F.concat(F.lit(a), F.col("event_id"), F.lit(b))
    path = F.when(n == 0, name("/data/s/", ".jsonl")).when(n == 1, name("/data/s/", ".JSONL")).when(n == 2, name("/data/.old/", ".jsonl")).when(n == 3, name("/data/s/.", ".jsonl")).when(n == 4, name("/data/", ".json")).otherwise(name("/data/a/b/", ".jsonl"))
    return e.select(path.alias("path")).where(J.is_session_path(F.col("path"), "/data"))


@query(
    f"""SELECT source AS agent_id, doc_id || '.jsonl' AS session_file, length(text) <= 2000 AS success, CASE WHEN length(text) <= 2000 AND doc_id % 3 <> 0 THEN 1 ELSE 0 END AS new_trajectory_count,
    CASE WHEN length(text) <= 2000 THEN CASE WHEN {strip_sql('text')} = '' THEN 0 ELSE len(string_split({strip_sql('text')}, chr(10))) END END AS lines,
    CASE WHEN length(text) > 2000 THEN 'File too large: ' || doc_id || '.jsonl' END AS error FROM documents"""
)
def src02_ingested_files(spark, sf):
    d = X.table(spark, sf, "documents")
    name = F.concat("doc_id", F.lit(".jsonl"))
    known = d.where("doc_id % 3 = 0").select(F.col("source").alias("agent_id"), name.alias("session_file"))
    files = d.select("source", name.alias("session"), F.length("text").cast("long").alias("size"), "text")
    return J.ingested(files, F.col("source"), known, cap=2000)


@query("SELECT event_id, event_id % 7 IN (0, 1) AS blocks FROM events")
def fn42_is_blocks(spark, sf):
    n = F.col("event_id") % 7
    texts = ['[{"type":"text","text":"a"},{"type":"thinking","thinking":"b"}]', '[{"type":"tool_use","id":"x"}]', '[{"type":"text"}]', "[]", '"text"', '[{"type":"image"}]', '[{"type":"text","text":"a"},"b"]']
    content = F.element_at(F.array(*map(F.lit, texts)), (n + 1).cast("int"))
    blocks = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    return X.table(spark, sf, "events").select("event_id", J.is_blocks(blocks).alias("blocks"))


def _one_line_sessions(spark, sf, role, *blocks):
    """A session for every message, of one line in blocks; T in a block is the message's text."""
    c = X.table(spark, sf, "conversations")
    body = F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit(a), JT.quoted(F.col("text")), F.lit(b)) if b else F.lit(a) for a, _, b in (x.partition("T") for x in blocks)]), F.lit("]"))
    raw = F.concat(F.lit(f'{{"role": "{role}", "content": '), body, F.lit(', "stop_reason": " stop "}'))
    return J.messages(c.select(F.concat("conv_id", F.lit("-"), "turn").alias("session"), F.lit(1).cast("long").alias("line_no"), raw.alias("raw")))


_ID = "conv_id || '-' || turn AS session"


@query(
    f"""SELECT {_ID}, 1 AS msg_idx, 'user' AS role, {strip_sql("text || chr(10) || 'two '")} AS content, NULL AS tool_call_id FROM conversations
    UNION ALL SELECT {_ID}, 2, 'tool', '[{{"type": "text", "text": "out", "n": 1.5}}]', 't1' FROM conversations UNION ALL SELECT {_ID}, 3, 'tool', ' as is ', '' FROM conversations UNION ALL SELECT {_ID}, 4, 'user', 'end', NULL FROM conversations"""
)
def fn43_user_blocks(spark, sf):
    m = _one_line_sessions(
        spark, sf, "user", '{"type":"text","text":T}', '{"type":"text","text":"two "}', '{"type":"tool_result","tool_use_id":"t1","content":[{"type":"text","text":"out","n":1.5}]}',
        '{"type":"text","text":" "}', '{"type":"tool_result","content":" as is "}', '{"type":"text","text":" end"}',
    )
    return m.select("session", "msg_idx", "role", "content", "tool_call_id")


@query(f"SELECT {_ID}, {strip_sql('text || chr(10) || chr(10)')} AS content, 'a' || chr(10) || chr(10) || {strip_sql('text')} AS reasoning_content, 'stop' AS stop_reason FROM conversations")
def fn44_assistant_blocks(spark, sf):
    m = _one_line_sessions(spark, sf, "assistant", '{"type":"thinking","thinking":" a "}', '{"type":"text","text":T}', '{"type":"thinking","thinking":" "}', '{"type":"thinking","thinking":T}', '{"type":"text","text":"\\n"}')
    return m.select("session", "content", "reasoning_content", "stop_reason")


@query(f"SELECT {_ID}, {strip_sql('''text || chr(10) || ' thought ' ''')} AS content FROM conversations")
def fn45_system_blocks(spark, sf):
    m = _one_line_sessions(spark, sf, "system", '{"type":"text","text":T}', '{"type":"tool_use","id":"no"}', '{"type":"thinking","thinking":" thought "}')
    return m.select("session", "content")


@query(f"""SELECT {_ID}, '[{{"id": "u1", "type": "function", "function": {{"name": "f", "arguments": "{{\\"b\\": [1, 2], \\"a\\": null}}"}}}}, {{"id": "", "type": "function", "function": {{"name": "g", "arguments": ' || CAST(to_json(text) AS VARCHAR) || '}}}}]' AS tool_calls FROM conversations""")
def fn46_tool_use(spark, sf):
    m = _one_line_sessions(spark, sf, "assistant", '{"type":"tool_use","id":"u1","name":"f","input":{"b":[1,2],"a":null}}', '{"type":"tool_use","name":"g","input":T}')
    return m.select("session", "tool_calls")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN '{\"k\": [1, {\"z\": \"' || event_type || '\"}], \"a\": true}' ELSE '12' END AS body FROM events")
def fn47_tool_result(spark, sf):
    e, n = X.table(spark, sf, "events"), F.col("event_id") % 4
    raw = F.when(n == 0, "null").when(n == 2, F.concat(F.lit('{"k":[1,{"z":"'), "event_type", F.lit('"}],"a":true}'))).when(n == 3, "12")
    return e.select("event_id", J.result_text(F.when(n == 1, F.col("event_type")), raw).alias("body"))


_CANON = """CASE role WHEN 'assistant' THEN '{"content": ' || CAST(to_json(said) AS VARCHAR) || ', "reasoning_content": ' || CASE WHEN thinks THEN '"' || reason || '"' ELSE '""' END || ', "role": "assistant"'
    || CASE WHEN stops THEN ', "stop_reason": "end"' ELSE '' END || ', "tool_calls": ' || CASE WHEN calls IS NULL THEN 'null' ELSE '[{"function": {"arguments": "{\\"n\\": ' || msg_idx || '}", "name": "look"}, "id": "c' || msg_idx || '", "type": "function"}]' END || '}'
    WHEN 'tool' THEN '{"content": ' || CAST(to_json(content) AS VARCHAR) || ', "name": "", "role": "tool", "tool_call_id": ""}' ELSE '{"content": ' || CAST(to_json(said) AS VARCHAR) || ', "role": "' || role || '"}' END"""


@query(ctes("native") + f"SELECT session, msg_idx, {_CANON} AS canonical FROM native")
def fn14_canonical_message(spark, sf):
    return X.native(spark, sf).select("session", "msg_idx", M.canonical().alias("canonical"))


@query(ctes("native") + f"SELECT session, '[' || string_agg({_CANON}, ', ' ORDER BY msg_idx) || ']' AS canonical FROM native GROUP BY session")
def fn50_canonical_list(spark, sf):
    return M.canonical_list(X.native(spark, sf), ["session"])


@query(ctes("native") + f"SELECT session, substr(sha256('[' || string_agg({_CANON}, ', ' ORDER BY msg_idx) || ']'), 1, 16) AS fingerprint FROM native GROUP BY session")
def fn13_fingerprint(spark, sf):
    return M.fingerprint(X.native(spark, sf), ["session"])


_CALLS = """'<tool_call>' || chr(10) || '<function=' || event_type || '>' || chr(10) || '<parameter=k>' || chr(10) || event_id || chr(10) || '</parameter>' || chr(10) || '<parameter=s>' || chr(10) || 'a "b"' || chr(10)
    || '</parameter>' || chr(10) || '<parameter=l>' || chr(10) || '[1, {"x": null}]' || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>' || chr(10)
    || '<tool_call>' || chr(10) || '<function=raw>' || chr(10) || '<parameter=_raw>' || chr(10) || 'not json' || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>'"""


def _called(spark, sf):
    e = X.table(spark, sf, "events")
    arguments = F.concat(F.lit('{"k":'), "event_id", F.lit(',"s":"a \\"b\\"","l":[1,{"x":null}]}'))
    calls = F.concat(F.lit('[{"id":"1","function":{"name":"'), "event_type", F.lit('","arguments":'), JT.quoted(arguments), F.lit('}},{"function":{"name":"raw","arguments":"not json"}}]'))
    return e.select("event_id", calls.alias("tool_calls"))


@query(f"SELECT event_id, {_CALLS} AS rendered FROM events")
def fn32_rendered_calls(spark, sf):
    return _called(spark, sf).select("event_id", M.rendered_calls(F.col("tool_calls")).alias("rendered"))


@query(
    f"""SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'user' ELSE 'assistant' END AS role, CASE event_id % 4 WHEN 0 THEN {_CALLS} WHEN 1 THEN 'said' || chr(10) || chr(10) || {_CALLS} ELSE 'said' END AS content,
    CASE WHEN event_id % 4 = 1 THEN 'why' END AS reasoning_content FROM events"""
)
def fn33_training_message(spark, sf):
    n = F.col("event_id") % 4
    m = _called(spark, sf).withColumns(
        {
            "role": F.when(n == 3, "user").otherwise("assistant"),
            "content": F.when(n == 0, " ").otherwise("said"),
            "tool_calls": F.when(n == 2, "[]").otherwise(F.col("tool_calls")),
            "reasoning_content": F.when(n.isin(1, 3), "why").otherwise(""),
        }
    )
    return m.select("event_id", M.training_message().alias("t")).select("event_id", "t.role", "t.content", "t.reasoning_content")


_REPLIES = [
    ("Here: ```json\n[{\"id\":%s}]\n``` and [more]", "[{\"id\": %s}]"),
    ("```\n{\"id\":%s,\"t\":\"a\nb\"}\n```", "{\"id\": %s, \"t\": \"a\\nb\"}"),
    ("I think {not this} but [%s, 2] (see [note])", "[%s, 2]"),
    ("%s nothing here", "[]"),
    ("```json\n{\"open\":%s", "[]"),
    (" {\"id\":%s} ", "{\"id\": %s}"),
]


def _replies_sql(side: int) -> str:
    part = lambda t: " || event_id || ".join("'" + x.replace("'", "''") + "'" for x in t.split("%s"))
    return "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {part(r[side])}" for i, r in enumerate(_REPLIES)) + " END"


def _replies(spark, sf):
    e, out = X.table(spark, sf, "events"), F.lit(None).cast("string")
    for i, (t, _) in enumerate(_REPLIES):
        a, _, b = t.partition("%s")
        out = F.when(F.col("event_id") % 6 == i, F.concat(F.lit(a), "event_id", F.lit(b))).otherwise(out)
    return e.select("event_id", out.alias("reply"))


@query(f"SELECT event_id, {_replies_sql(1)} AS value FROM events")
def fn38_json_of_reply(spark, sf):
    return _replies(spark, sf).select("event_id", JT.from_reply(F.col("reply")).alias("value"))


@query("SELECT event_id, '{\"a\": ' || event_id || '}' AS value FROM events")
def fn37_first_json_value(spark, sf):
    text = F.concat(F.lit('so {it is} [ x {"a":'), "event_id", F.lit("} and {\"b\":1}]"))
    return X.table(spark, sf, "events").select("event_id", JT.first_value(text).alias("value"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{\"summary\":{\"k\":' || event_id || '}}' ELSE '{}' END AS quality FROM events")
def fn55_quality_object(spark, sf):
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.concat(F.lit('{"summary":{"k":'), "event_id", F.lit("}}"))).when(n == 1, "[1]").when(n == 2, "{bad").when(n == 3, "")
    return X.table(spark, sf, "events").select("event_id", F.coalesce(JT.object_or_empty(text), F.lit("{}")).alias("quality"))
