"""Session files, packages and the maintenance stream."""

import hashlib
import json

from pyspark.sql import functions as F

from sparkloom.functions import jsontext as JT
from sparkloom.functions import messages as M
from sparkloom.sources import packages as P
from sparkloom.sources import sessions as J
from sparkloom.streaming import maintenance

BLOCKS = [
    {"_type": "metadata", "x": 1},
    {"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}, {"type": "tool_result", "tool_use_id": "t1", "content": "out"}, {"type": "text", "text": "three"}]},
    {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t2", "name": "f", "input": {"a": 1}}], "stop_reason": "end"},
    {"role": "developer", "content": "x"},
    {"role": "assistant", "content": []},
]
PLAIN = [{"role": "user", "content": " hello "}, {"role": "tool", "content": ""}, {"role": "assistant", "content": "", "reasoning_content": "r", "tool_calls": [{"id": "c"}]}, {"role": "assistant", "content": " "}]


def lines(spark, sessions):
    rows = [(name, "\n".join([*map(json.dumps, ms), "not json", ""])) for name, ms in sessions.items()]
    return J.lines(spark.createDataFrame(rows, "session string, text string"))


def test_dialects(spark):
    got = {r.session: r.dialect for r in J.dialects(lines(spark, {"b": BLOCKS, "p": PLAIN})).collect()}
    assert got == {"b": "blocks", "p": "plain"}


def test_block_messages(spark):
    got = J.messages(lines(spark, {"b": BLOCKS})).orderBy("msg_idx").collect()
    assert [(r.role, r.content) for r in got] == [("user", "one\ntwo"), ("tool", "out"), ("user", "three"), ("assistant", "hi"), ("assistant", "[]")]
    assert got[1].tool_call_id == "t1" and got[1].body == "(id=t1)\nout"
    assert got[3].reasoning_content == "hm" and got[3].stop_reason == "end"
    assert json.loads(got[3].tool_calls)[0]["function"] == {"name": "f", "arguments": '{"a": 1}'}
    assert got[3].body.startswith("[reasoning]\nhm\n\n[tool_calls]\n[")


def test_plain_messages_keep_empty_tool_rows(spark):
    got = J.messages(lines(spark, {"p": PLAIN})).orderBy("msg_idx").collect()
    assert [(r.msg_idx, r.role, r.body) for r in got][:2] == [(1, "user", "hello"), (2, "tool", "")]
    assert len(got) == 3 and "[tool_calls]" in got[2].body


def test_fingerprints(spark):
    m = J.messages(lines(spark, {"a": PLAIN, "b": PLAIN, "c": [*PLAIN, {"role": "user", "content": "more"}]}))
    got = {r.session: r.fingerprint for r in M.fingerprint(m, ["session"]).collect()}
    assert got["a"] == got["b"] != got["c"] and all(len(x) == 16 for x in got.values())


def packed(bodies, most):
    out, used, w, alone = [], 0, -1, True
    for role, b in bodies:
        n = len(role) + len(b) + 4
        if n > most:
            w, alone, used = w + 1, True, n
        elif not alone and used + 1 + n <= most:
            used += 1 + n
        else:
            w, alone, used = w + 1, False, n
        out.append(w)
    return out


def test_token_windows(spark):
    bodies = [("user", "x" * 100), ("assistant", "y" * 120), ("user", "z" * 300), ("user", "a"), ("tool", "b" * 240), ("user", "c")]
    df = spark.createDataFrame([("s", i + 1, r, b) for i, (r, b) in enumerate(bodies)], "session string, msg_idx long, role string, body string")
    got = M.windows(df, ["session"], 256).orderBy("msg_idx").collect()
    assert [r.window for r in got] == packed(bodies, 256)
    assert len(got[2].text) <= 256 - 8 and got[2].text.endswith("…")


def test_within_budget(spark):
    df = spark.createDataFrame([("s", 1, "user", "hello"), ("s", 2, "user", "w" * 50), ("s", 3, "user", "no")], "session string, msg_idx long, role string, body string")
    text = M.within_budget(df, ["session"], 40).first().text
    assert text == "[user]: hello\n[user]: " + "w" * 18 + "…"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_text('{"role":"user","content":"x"}\n')
    (tmp_path / "b.JSONL").write_text("{}")
    (tmp_path / ".hidden" / "c.jsonl").write_text("x")
    (tmp_path / "d.txt").write_text("x")
    (tmp_path / "big.jsonl").write_text("x" * 50)
    got = {r.session.rsplit("/", 1)[-1]: r.text for r in J.read_files(spark, str(tmp_path), cap=40).collect()}
    assert set(got) == {"a.jsonl", "b.JSONL", "big.jsonl"} and got["big.jsonl"] is None and got["b.JSONL"] == "{}"


def test_files_over_the_cap_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"ok \xff\nsecond")
    (tmp_path / "big.jsonl").write_text("x" * 50)
    files = J.read_files(spark, str(tmp_path), cap=40)
    known = spark.createDataFrame([], "agent_id string, session_file string")
    got = {r.session_file.rsplit("/", 1)[-1]: r for r in J.ingested(files, F.lit("me"), known, cap=40).collect()}
    assert (got["a.jsonl"].success, got["a.jsonl"].lines, got["a.jsonl"].new_trajectory_count) == (True, 2, 1)
    assert not got["big.jsonl"].success and got["big.jsonl"].error.startswith("File too large")
    assert files.where("session LIKE '%a.jsonl'").first().text == "ok \ufffd\nsecond"
    seen = J.ingested(files, F.lit("me"), J.ingested(files, F.lit("me"), known, cap=40), cap=40)
    assert {r.new_trajectory_count for r in seen.collect()} == {0}


def test_canonical_json_is_that_of_python(spark):
    rows = [
        ("s", 1, "user", ' a "q" \n\\u000B \x0b\x1f\x7f é漏 ', None, None, None, None, None),
        ("s", 2, "assistant", "x", '[{"id": "1", "b": {"z": 1.50, "a": [true, null]}}]', " r ", None, None, " stop "),
        ("s", 3, "tool", " kept ", None, None, " n ", "t", None),
        ("s", 4, "other", "x", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "session string, msg_idx long, role string, content string, tool_calls string, reasoning_content string, name string, tool_call_id string, stop_reason string")
    want = [
        {"role": "user", "content": rows[0][3].strip()},
        {"role": "assistant", "content": "x", "reasoning_content": "r", "tool_calls": json.loads(rows[1][4]), "stop_reason": "stop"},
        {"role": "tool", "content": " kept ", "name": "n", "tool_call_id": "t"},
        {"role": "other"},
    ]
    text = json.dumps(want, sort_keys=True, ensure_ascii=False)
    assert M.canonical_list(df, ["session"]).first().canonical == text
    assert M.fingerprint(df, ["session"]).first().fingerprint == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_replies(spark):
    texts = ['```json\n{"a": 1}\n```', 'no', '[1, 2] and ]', 'x {bad} {"k": "a\tb"}', "", None, "[" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(JT.from_reply(F.col("t")).alias("v")).collect()] == ['{"a": 1}', "[]", "[1, 2]", '{"k": "a\\tb"}', "[]", "[]", "[]"]


def test_packages(spark, tmp_path):
    root = tmp_path / "skills"
    files = {
        "fetch-1.2.0/SKILL.md": "---\nname: 'Fetch'\ndescription: gets\n  more\nname: Fetch it\nmetadata: {\"x\": 1}\n---\n\nBody\n",
        "fetch-1.2.0/meta.json": '{"ownerId": "me", "slug": "fetch", "version": "1.2.0", "publishedAt": 7}',
        "fetch-1.2.0/scripts/x.py": "pass",
        "bare/SKILL.md": "---\nname: bare\n---\nJust text",
        "none/SKILL.md": "no front matter",
        ".hidden/SKILL.md": "---\nname: h\n---\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.md").write_bytes(b"\xff\xfe")
    tree = P.read_tree(spark, str(root))
    assert {r.path for r in tree.collect()} == set(files) - {".hidden/SKILL.md"}
    got = {r.dir: r for r in P.skills(tree).collect()}
    f, b = got["fetch-1.2.0"], got["bare"]
    assert set(got) == {"fetch-1.2.0", "bare"}
    assert (f.owner, f.slug, f.version, f.published_at, f.name, f.description, f.text, f.metadata) == ("me", "fetch", "1.2.0", 7, "Fetch it", "gets\n  more", "Body", '{"x": 1}')
    assert f.scripts == {"x.py": "pass"} and (b.owner, b.slug, b.version, b.text, b.scripts) == ("unknown", "bare", "1.0.0", "Just text", {})
    assert P.read_tree(spark, str(root), allow=["*.py"]).count() == 1
    assert P.skill_text(tree, "fetch").first().version == "1.2.0" and P.skill_text(tree, "fetch", "9").count() == 0


def test_adoption_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", 2), (1, "2024-01-01 05:00:00", 1), (2, "2024-01-02 01:00:00", 1)]
    src = str(tmp_path / "hits")
    spark.createDataFrame(rows, "id long, t string, weight long").select("id", F.col("t").cast("timestamp_ntz").alias("ts"), "weight").write.parquet(src)
    counts = maintenance.adoption_stream(maintenance.hit_log(spark, src))
    q = counts.writeStream.format("memory").queryName("adoption").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert {(r.id, r.hits) for r in spark.table("adoption").collect()} == {(1, 3), (2, 1)}


def test_maintenance(spark, tmp_path):
    src, seen = tmp_path / "hits", {}
    spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "id long, weight long").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).select("id", "ts", "weight").write.parquet(str(src))
    out = tmp_path / "out"

    def bad(batch, batch_id):
        raise ValueError("no")

    steps = {"bad": bad, "sum": lambda b, i: b.groupBy("id").agg(F.sum("weight").alias("n")).write.mode("overwrite").parquet(str(out))}
    q = maintenance.maintain(maintenance.hit_log(spark, str(src)), steps, str(tmp_path / "cp"), seen=lambda i, r: seen.update(r))
    q.awaitTermination(60)
    assert seen["sum"] == "ok" and seen["bad"].startswith("failed")
    assert {(r.id, r.n) for r in spark.read.parquet(str(out)).collect()} == {(1, 3), (2, 1)}


def test_reading_on(spark):
    """Only lines behind the last one read come again; a file as large as before is not looked into, a shorter one starts anew."""
    from pyspark.sql import functions as F

    from sparkloom.sources import sessions as J

    rows = [("grown", "a\nb\nc\n"), ("same", "x\ny"), ("new", "p"), ("empty", "  "), ("short", "q"), ("large", "z" * 100), ("none", None)]
    files = spark.createDataFrame([(n, len(t or ""), t) for n, t in rows], "session string, size long, text string")
    before = spark.createDataFrame([("me", "grown", 1, 2), ("me", "same", 1, 3), ("me", "short", 5, 50), ("you", "new", 1, 1)], "agent_id string, session_file string, lines long, size long")
    got, now = J.read_on(files, F.lit("me"), before, cap=50)
    assert sorted((r.session_file, r.line_no, r.raw) for r in got.collect()) == [("grown", 2, "b"), ("grown", 3, "c"), ("new", 1, "p"), ("short", 1, "q")]
    assert {(r.agent_id, r.session_file): (r.lines, r.size) for r in now.collect()} == {
        ("me", "grown"): (3, 6), ("me", "same"): (1, 3), ("me", "new"): (1, 1), ("me", "empty"): (0, 2), ("me", "short"): (1, 1), ("you", "new"): (1, 1), ("me", "none"): (0, 0),
    }
    again, same = J.read_on(files, F.lit("me"), now, cap=50)
    assert again.count() == 0 and sorted(map(str, same.collect())) == sorted(map(str, now.collect()))


def test_totals_fall_through(spark):
    from sparkloom.sources import sessions as J

    rows = [(True, 3, 9, 1), (True, 0, 4, 1), (True, None, 0, 1), (True, None, None, None), (False, 8, 8, 1)]
    df = spark.createDataFrame(rows, "success boolean, memories_uploaded int, total_uploaded int, new_trajectory_count int")
    assert tuple(J.ingest_totals(df).first()) == (5, 4, 8)
    assert tuple(J.ingest_totals(df.limit(0)).first()) == (0, 0, 0)
    assert tuple(J.ingest_totals(df.select("success", "new_trajectory_count")).first()) == (5, 4, 3)


def test_extractor_as_a_table_function(spark):
    """It sees each window whole and in order, and gives what the array form gives."""
    from sparkloom.operators import extraction as Q

    def extract(texts):
        return [{"content": f"{len(texts)}:{t}", "tags": [texts[0]]} for t in texts if t] + [{"content": " "}]

    rows = [("b", 2, "y"), ("a", 1, "m"), ("b", 1, "x"), ("b", 3, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "key string, place int, text string").repartition(3)
    got = sorted((r.key, r.pos, r.content, tuple(r.tags)) for r in Q.extracted_by_table(df, Q.table_extractor(extract)).collect())
    assert got == [("a", 0, "1:m", ("m",)), ("b", 0, "3:x", ("x",)), ("b", 1, "3:y", ("x",))]
