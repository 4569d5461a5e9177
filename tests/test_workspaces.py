"""Whole workspaces put into another product."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import sections as S
from sparkloom.operators import workspace as O


def merged(spark, files, source, target, source_defaults=(), target_defaults=(), skills=()):
    incoming = spark.createDataFrame([(1, i, p, t) for i, (p, t) in enumerate(files)], "workspace long, pos int, path string, text string")
    both = [(source, i, p, t) for i, (p, t) in enumerate(source_defaults)] + ([(target, i, p, t) for i, (p, t) in enumerate(target_defaults)] if target != source or not source_defaults else [])
    defaults = spark.createDataFrame(both, "product string, pos int, path string, text string")
    w = spark.createDataFrame([(1, source, target)], "workspace long, source string, target string")
    out = O.merge_workspaces(incoming, w, defaults, spark.createDataFrame([(1, s) for s in skills], "workspace long, name string"))
    return {r.path: r.content for r in out.files.collect()}, [(r.path, r.action, r.detail) for r in out.log.orderBy("step", "pos").collect()]


def test_same_product_imports_directly(spark):
    files, log = merged(spark, [("SOUL.md", "my soul"), ("TOOLS.md", "my tools"), ("memory/x.md", "m"), ("a.txt", "a")], "nanobot", "nanobot", [("SOUL.md", "my soul"), ("USER.md", "u")])
    assert files == {"SOUL.md": "my soul", "TOOLS.md": "my tools", "memory/x.md": "m", "a.txt": "a", "USER.md": "u"}
    assert [x[2] for x in log] == ["User data imported directly", "Same product, imported directly", "Memory file imported directly", "Imported directly", "Added from nanobot default template"]


def test_skills(spark):
    """A skill that is there is skipped; one whose file equals a default is imported like any other."""
    files, log = merged(spark, [("skills/old/SKILL.md", "x"), ("skills/new/b.md", "same"), ("skills/x", "y")], "nanobot", "openclaw", [("skills/new/b.md", "same")], [("skills/new/b.md", "theirs")], ["old"])
    assert files == {"skills/new/b.md": "same", "skills/x": "y"}
    assert [x[:2] for x in log] == [("skills/old/SKILL.md", "skip"), ("skills/new/b.md", "import"), ("skills/x", "import")]
    assert log[0][2] == "Skill 'old' already exists on target, skipped"


def test_sections_across_products(spark):
    default = "## Identity\ndefault identity\n## Rules\ndefault rules"
    files, log = merged(spark, [("SOUL.md", "## Identity\nuser identity\n## Rules\ndefault rules\n## Extra\nmore")], "nanobot", "openclaw", [("SOUL.md", default)], [("SOUL.md", default.replace("default rules", "their rules"))])
    assert files == {"SOUL.md": "\n## Identity\nuser identity\n## Rules\ntheir rules\n## Extra\nmore"}
    assert log == [("SOUL.md", "merged", "target default + 2 user customization(s)")]


@pytest.mark.parametrize("text, want", [("a\nb\nmine", "T\n\n## Imported from nanobot USER.md\n\nmine\n"), (" a\nb ", "T \n"), ("", "T \n")])
def test_another_path_takes_what_the_user_added(spark, text, want):
    files, log = merged(spark, [("USER.md", text)], "nanobot", "hermes", [("USER.md", "a\nb")], [("memories/USER.md", "T \n")])
    assert files == {"memories/USER.md": want}
    assert log[0][:2] == ("memories/USER.md", "merged" if "mine" in text else "default")


def test_places_and_tasks(spark):
    beat = "## Active Tasks\n- one\n<!-- end -->\n## Rules\nr"
    files, log = merged(
        spark,
        [("memory/MEMORY.md", "m"), ("memory/HISTORY.md", "h"), ("HEARTBEAT.md", beat.replace("- one", "- one\n- two")), ("AGENTS.md", "a"), ("MEMORY.md", "later"), ("memory/d.md", "d")],
        "nanobot", "openclaw", [("HEARTBEAT.md", beat)], [("HEARTBEAT.md", beat.replace("- one", "- uno")), ("IDENTITY.md", "i")],
    )
    assert files["HEARTBEAT.md"].count("- two") == 2  # once with the changed section, once as a task
    assert {p: files[p] for p in files if p != "HEARTBEAT.md"} == {"MEMORY.md": "later", "memory/HISTORY.md": "h", "AGENTS.md": "a", "memory/d.md": "d", "IDENTITY.md": "i"}
    assert ("MEMORY.md", "import", "Imported from memory/MEMORY.md → MEMORY.md") in log
    assert ("memory/HISTORY.md", "import", "No mapping for openclaw, imported as-is") in log
    assert ("AGENTS.md", "import", "No target default available, imported as-is") in log
    assert log[-1] == ("IDENTITY.md", "default", "Added from openclaw default template")


def test_sections_are_parsed_once_a_row(spark):
    """Each text is parsed once, not again for each of its sections: the plan splits no text inside a lambda over sections."""
    df = spark.createDataFrame([("## A\nx\n## B\ny",) * 3], "u string, s string, t string")
    plan = df.select(S.merged_tasks(F.col("u"), F.col("s"), F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"coalesce({c}#") == 1 for c in "ust")


def plans(spark, tmp_path, monkeypatch):
    """Plans of what merge_workspaces saves and returns over files that are many rows made of a small table on disk."""
    spark.range(50).select(F.col("id").alias("workspace"), F.lit("nanobot").alias("source"), F.lit("openclaw").alias("target")).write.parquet(str(tmp_path / "w"))
    w = spark.read.parquet(str(tmp_path / "w"))
    incoming = w.select("workspace", F.posexplode(F.array(*[F.lit(f"{i}.md") for i in range(20)])).alias("pos", "path"), F.lit("text").alias("text"))
    skills = w.select("workspace", F.lit("a").alias("name"))
    defaults = spark.createDataFrame([("nanobot", 0, "SOUL.md", "s"), ("openclaw", 0, "SOUL.md", "s")], "product string, pos int, path string, text string")
    seen = []
    real = O.saved
    monkeypatch.setattr(O, "saved", lambda df, name: seen.append(df) or real(df, name))
    out = O.merge_workspaces(incoming, w, defaults, skills)
    assert out.log.count() == 50 * 21 and out.files.count() == 50 * 21
    return [d._jdf.queryExecution().executedPlan().toString() for d in (*seen, out.log, out.files)]


def test_only_templates_are_broadcast(spark, tmp_path, monkeypatch):
    """Files, workspaces and skills are never broadcast, however small the file that they are made of: their rows are many."""
    rows, log, files = plans(spark, tmp_path, monkeypatch)
    assert rows.count("+- BroadcastExchange") == 2 and rows.count("SortMergeJoin") == 2
    assert "BuildLeft" not in rows + log + files
    assert all(p.count("+- BroadcastExchange") == 1 and "LeftAnti" in p and "BroadcastHashJoin [workspace" not in p for p in (log, files))
