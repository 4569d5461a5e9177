"""Workspaces put into another product: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import workspace as O
from sparkloom.plans.registry import query, strip_sql
from sparkloom.sources import fixtures as X

_PRODUCTS = ["nanobot", "openclaw", "hermes", "other"]
_FILES = [
    "SOUL.md", "USER.md", "memories/USER.md", "memory/MEMORY.md", "MEMORY.md", "memory/HISTORY.md", "IDENTITY.md", "AGENTS.md", "HEARTBEAT.md", "TOOLS.md", "BOOTSTRAP.md",
    "skills/a/SKILL.md", "skills/b/SKILL.md", "memory/2024.md", "notes.txt",
]
#: Templates that a product has; a workspace of another product has none.
_TEMPLATES = [(p, f) for p in _PRODUCTS[:3] for f in _FILES[:11] if (p, f) != ("openclaw", "TOOLS.md") and not (p == "hermes" and f in ("HEARTBEAT.md", "IDENTITY.md"))]


def _template(product: str, file: str) -> str:
    if file == "HEARTBEAT.md":
        return f"{product}\n## Active Tasks\n- first\n<!-- end of tasks -->\n## Rules\nbe good to {product}"
    return f"## Who\n{product} {file}\n## Rules\nbe good"


def _tables(spark, sf):
    """One workspace for each customer: most files, each as the template, changed, with a section or a task more, or without sections."""
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("workspace"), "c_name")
    pick = lambda k: F.element_at(F.array(*map(F.lit, _PRODUCTS)), (k % 4 + 1).cast("int"))
    w = c.select("workspace", pick(F.col("workspace")).alias("source"), pick(F.floor(F.col("workspace") / 4)).alias("target"), "c_name")
    files = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("path")) for i, f in enumerate(_FILES)])
    own = {f"{p}/{f}": _template(p, f) for p, f in _TEMPLATES}
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.concat("source", F.lit("/"), "path")), F.lit("## Who\nnobody"))
    kind, name = (F.col("workspace") + 2 * F.col("pos")) % 5, F.col("c_name")
    text = (
        F.when(kind == 0, base)
        .when(kind == 1, F.concat(F.lit("## Who\n"), name, F.lit("\n## Rules\nbe good")))
        .when(kind == 2, F.concat(base, F.lit("\n## Mine\n"), name))
        .when(kind == 3, F.concat(F.lit("mine\n## Active Tasks\n- first\n- ask "), name, F.lit("\n<!-- end of tasks -->\n## Rules\nbe good")))
        .otherwise(name)
    )
    incoming = w.select("*", F.explode(files).alias("f")).select("workspace", "source", "c_name", "f.*").where("(workspace + pos) % 7 <> 0").select("workspace", "pos", "path", text.alias("text"))
    defaults = spark.createDataFrame([(p, i, f, _template(p, f)) for i, (p, f) in enumerate(_TEMPLATES)], "product string, pos int, path string, text string")
    skills = c.where("workspace % 3 = 0").select("workspace", F.lit("b").alias("name"))
    return incoming, w.drop("c_name"), defaults, skills


_list = lambda values: "[" + ", ".join("'" + v + "'" for v in values) + "]"
_quote = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'" if t else "''"
_rows = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else _quote(v) for v in r) + ")" for r in rows)
_secs = lambda t: f"""list_transform(string_split(regexp_replace(chr(10) || {t}, '\\n## ', chr(1) || '## ', 'g'), chr(1)), lambda p, i: CASE WHEN i = 1 THEN {{'title': '', 'body': substr(p, 2)}}
    ELSE {{'title': split_part(p, chr(10), 1), 'body': substr(p, length(split_part(p, chr(10), 1)) + 2)}} END)"""  # noqa: E731
_joined = lambda s: f"array_to_string(list_transform({s}, lambda x: CASE WHEN x.title <> '' THEN x.title || chr(10) || x.body ELSE x.body END), chr(10))"
_task = lambda b: f"list_filter(string_split(coalesce({b}, ''), chr(10)), lambda x: {strip_sql('x')} <> '' AND NOT starts_with({strip_sql('x')}, '<!--') AND NOT ends_with({strip_sql('x')}, '-->'))"
_classes = lambda classes: _rows([(p, f) for p, files in classes.items() if p is not None for f in files])
_known = lambda classes, product, path: f"""CASE WHEN {product} IN ('nanobot', 'openclaw', 'hermes') THEN ({product}, {path}) IN (VALUES {_classes(classes)}) ELSE {path} IN ({', '.join(_quote(f) for f in classes[None])}) END"""

#: The rule file by file: what a file is, where it goes, what becomes of it.
_SQL = f"""
    WITH w AS (SELECT c_custkey AS workspace, c_name, ({_list(_PRODUCTS)})[c_custkey % 4 + 1] AS source, ({_list(_PRODUCTS)})[(c_custkey // 4) % 4 + 1] AS target FROM customer),
    d(product, pos, path, text) AS (VALUES {_rows([(p, i, f, _template(p, f)) for i, (p, f) in enumerate(_TEMPLATES)])}),
    f(pos, path) AS (VALUES {_rows(enumerate(_FILES))}),
    i AS (SELECT w.*, f.pos, f.path, coalesce(d.text, '## Who' || chr(10) || 'nobody') AS base, (workspace + 2 * f.pos) % 5 AS kind FROM w JOIN f ON (workspace + f.pos) % 7 <> 0 LEFT JOIN d ON d.product = source AND d.path = f.path),
    t AS (SELECT *, CASE kind WHEN 0 THEN base WHEN 1 THEN '## Who' || chr(10) || c_name || chr(10) || '## Rules' || chr(10) || 'be good' WHEN 2 THEN base || chr(10) || '## Mine' || chr(10) || c_name
        WHEN 3 THEN 'mine' || chr(10) || '## Active Tasks' || chr(10) || '- first' || chr(10) || '- ask ' || c_name || chr(10) || '<!-- end of tasks -->' || chr(10) || '## Rules' || chr(10) || 'be good' ELSE c_name END AS text FROM i),
    m(source, path, target, moved) AS (VALUES {_rows([(s, p, t, to) for (s, p), by in O.PATHS.items() for t, to in by.items()])}),
    r AS (SELECT t.*, CASE WHEN t.source = t.target THEN t.path WHEN m.path IS NOT NULL THEN m.moved WHEN (t.source, t.path) IN (VALUES {_rows(O.PATHS)}) THEN NULL ELSE t.path END AS target_path FROM t LEFT JOIN m USING (source, path, target)),
    j AS (SELECT r.*, coalesce(a.text, '') AS sd, coalesce(b.text, '') AS td, {_known(O.PORTABLE, 'r.source', 'r.path')} AS portable, {_known(O.PORTABLE, 'r.target', 'r.path')} AS portable_there,
        {_known(O.CONFIG, 'r.source', 'r.path')} OR {_known(O.CONFIG, 'r.target', 'r.path')} AS config, r.path LIKE 'memory/%' OR r.path LIKE 'memories/%' AS memory
        FROM r LEFT JOIN d a ON a.product = r.source AND a.path = r.path LEFT JOIN d b ON b.product = r.target AND b.path = r.target_path),
    s AS (SELECT *, {_secs('text')} AS us, {_secs('sd')} AS ss, {_secs('td')} AS ts FROM j),
    k AS (SELECT *, list_transform(us, lambda u: {{'title': u.title, 'body': u.body, 'kind': CASE WHEN u.title = '' THEN CASE WHEN {strip_sql('u.body')} = {strip_sql('ss[1].body')} THEN 'unchanged' ELSE 'modified' END
        WHEN len(list_filter(ss, lambda x: x.title = u.title)) = 0 THEN 'added' WHEN {strip_sql('list_filter(ss, lambda x: x.title = u.title)[-1].body')} = {strip_sql('u.body')} THEN 'unchanged' ELSE 'modified' END}}) AS marks FROM s),
    b AS (SELECT *, list_concat(list_transform(ts, lambda t: {{'title': t.title, 'body': coalesce(list_filter(marks, lambda x: x.kind = 'modified' AND x.title = t.title)[-1].body, t.body)}}),
        list_transform(list_filter(marks, lambda x: x.kind = 'added'), lambda x: {{'title': x.title, 'body': x.body}})) AS fused, len(list_filter(marks, lambda x: x.kind <> 'unchanged')) AS n,
        list_filter({_task("list_filter(us, lambda x: x.title = '## Active Tasks')[1].body")}, lambda x: NOT list_contains({_task("list_filter(ss, lambda x: x.title = '## Active Tasks')[1].body")}, x)) AS new,
        CASE WHEN {strip_sql('sd')} = '' THEN {strip_sql('text')} ELSE array_to_string(list_filter(string_split({strip_sql('text')}, chr(10)), lambda x: {strip_sql('x')} <> '' AND NOT list_contains(string_split({strip_sql('sd')}, chr(10)), x)), chr(10)) END AS diff FROM k),
    e AS (SELECT *, list_transform(fused, lambda x, i: {{'title': x.title, 'body': CASE WHEN i = list_position(list_transform(fused, lambda z: z.title), '## Active Tasks') AND len(new) > 0 THEN array_to_string(list_concat(string_split(x.body, chr(10))[:list_position(list_transform(string_split(x.body, chr(10)),
        lambda y, q: q > 1 AND contains(y, '<!--')), true) - 1], new, string_split(x.body, chr(10))[list_position(list_transform(string_split(x.body, chr(10)), lambda y, q: q > 1 AND contains(y, '<!--')), true):]), chr(10)) ELSE x.body END}}) AS tasks FROM b),
    c AS (SELECT workspace, pos, coalesce(target_path, path) AS path, path AS old, target, source, target_path, td, text, diff, n, {_joined('fused')} AS merged, {_joined('tasks')} AS task_merged, CASE
        WHEN path LIKE 'skills/b/%' AND workspace % 3 = 0 THEN 'skip' WHEN path LIKE 'skills/%' THEN 'skill' WHEN target_path IS NULL THEN 'nowhere' WHEN source = target AND (portable OR portable_there) THEN 'user'
        WHEN source = target AND config THEN 'same' WHEN source = target AND memory THEN 'memory' WHEN source = target THEN 'other' WHEN portable AND td <> '' AND target_path = path THEN 'sections' WHEN portable AND td <> '' AND diff <> '' THEN 'appended'
        WHEN portable AND td <> '' THEN 'unchanged' WHEN portable THEN 'moved' WHEN config AND td = '' THEN 'bare' WHEN config AND target_path = 'HEARTBEAT.md' AND target <> 'hermes' THEN 'tasks' WHEN config THEN 'sections' WHEN memory THEN 'memory' ELSE 'other' END AS what FROM e),
    o AS (SELECT workspace, pos, path, target_path IS NOT NULL AND what NOT IN ('skip', 'skill') OR what <> 'skip' AS taken, CASE what WHEN 'skip' THEN 'skip' WHEN 'sections' THEN 'merged' WHEN 'appended' THEN 'merged' WHEN 'tasks' THEN 'merged' WHEN 'unchanged' THEN 'default' ELSE 'import' END AS action,
        CASE what WHEN 'skip' THEN NULL WHEN 'sections' THEN merged WHEN 'tasks' THEN task_merged WHEN 'appended' THEN rtrim(td, chr(10) || ' ') || chr(10) || chr(10) || '## Imported from ' || source || ' ' || old || chr(10) || chr(10) || diff || chr(10) WHEN 'unchanged' THEN td ELSE text END AS content,
        CASE what WHEN 'skip' THEN 'Skill ''' || split_part(old, '/', 2) || ''' already exists on target, skipped' WHEN 'skill' THEN 'Skill imported' WHEN 'nowhere' THEN 'No mapping for ' || target || ', imported as-is' WHEN 'user' THEN 'User data imported directly'
        WHEN 'same' THEN 'Same product, imported directly' WHEN 'memory' THEN 'Memory file imported directly' WHEN 'other' THEN 'Imported directly' WHEN 'appended' THEN 'Target template + user data from ' || old WHEN 'unchanged' THEN 'No user changes detected, using ' || target || ' default'
        WHEN 'moved' THEN 'Imported from ' || old || CASE WHEN target_path <> old THEN ' → ' || target_path ELSE '' END WHEN 'bare' THEN 'No target default available, imported as-is' ELSE 'target default + ' || n || ' user customization(s)' END AS detail FROM c),
    miss AS (SELECT w.workspace, d.pos, d.path, d.text AS content, target FROM w JOIN d ON d.product = w.target WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.workspace = w.workspace AND o.path = d.path AND o.taken))
"""


@query(_SQL + "SELECT workspace, path, arg_max(content, pos) AS content FROM o WHERE action <> 'skip' GROUP BY ALL UNION ALL SELECT workspace, path, content FROM miss")
def pipe20_workspace_merge(spark, sf):
    return O.merge_workspaces(*_tables(spark, sf)).files


@query(_SQL + "SELECT workspace, 1 AS step, pos, path, action, detail FROM o UNION ALL SELECT workspace, 2, pos, path, 'default', 'Added from ' || target || ' default template' FROM miss")
def pipe20_workspace_log(spark, sf):
    return O.merge_workspaces(*_tables(spark, sf)).log
