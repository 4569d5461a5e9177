"""Skill packages, presets, showcases, workspaces and raw uploads: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import knowledge as K
from sparkloom.operators import workspace as W
from sparkloom.plans.registry import query
from sparkloom.scratch import saved
from sparkloom.sources import fixtures as X
from sparkloom.sources import packages as P
from sparkloom.sources.fixtures import ctes


def _cases(key: str, values: list, of=F.lit):
    n, out = F.col(key) % len(values), F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(n == i, of(v) if isinstance(v, str) else v).otherwise(out)
    return out


# Front matter values, their kinds and what is read of them.
_VALUES = [("'quoted'", "string", "quoted"), ("12", "int", "12"), ("1.50", "float", "1.50"), ("TRUE", "bool", "true"), ("~", "null", None), ('{"a": [1]}', "json", '{"a": [1]}'), ("[a", "string", "[a"), ("plain: text", "string", "plain: text"), ("", "string", "")]


def _sql_cases(key: str, values: list[str | None]) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_sql_cases('p_partkey', [k for _, k, _ in _VALUES])} AS kind, {_sql_cases('p_partkey', [v for _, _, v in _VALUES])} AS value FROM part")
def fn30_typed_value(spark, sf):
    raw = _cases("p_partkey", [F.concat(F.lit(v), F.lit(" ")) for v, _, _ in _VALUES])
    return X.table(spark, sf, "part").select("p_partkey", P.typed_value(raw).alias("t")).select("p_partkey", "t.kind", "t.value")


def _skill_md(name, description, categories: str, body):
    front = F.concat(F.lit("---\nname: first\nname: '"), name, F.lit("'\ndescription:\n  "), description, F.lit("\n  more: of it\nmetadata: {\"own\": {\"categories\": "), F.lit(categories), F.lit("}}\n---\n\n"))
    return F.concat(front, body, F.lit("\n"))


def _tree(spark, sf):
    """Packages of the parts: every tenth has no front matter, every second a _meta.json, every third a script."""
    p = X.dealt(X.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    folder = F.concat(F.lit("pkg"), F.col("p_partkey") % 50, F.lit("-1."), F.col("p_partkey"), F.lit(".0"))
    md = F.when(F.col("p_partkey") % 10 == 9, F.col("p_name")).otherwise(_skill_md(F.col("p_name"), F.col("p_type"), '["general"]', F.concat(F.lit("# Use "), "p_brand")))
    meta = F.concat(F.lit('{"ownerId": "o", "slug": "s-'), F.col("p_partkey") % 50, F.lit('", "version": "1.'), "p_partkey", F.lit('.0", "publishedAt": '), "p_partkey", F.lit("}"))
    files = [
        (F.lit(True), "/SKILL.md", md),
        (F.col("p_partkey") % 2 == 0, "/_meta.json", meta),
        (F.col("p_partkey") % 3 == 0, "/scripts/run.py", F.concat(F.lit("print("), "p_partkey", F.lit(")"))),
        (F.col("p_partkey") % 3 == 0, "/scripts/sub/no.py", F.lit("x")),
    ]
    each = F.array(*[F.when(c, F.struct(F.concat(folder, F.lit(n)).alias("path"), t.alias("text"))) for c, n, t in files])
    return p.select(F.explode(F.array_compact(each)).alias("f")).select("f.*")


_PACKAGES = """packages AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 50) || '-1.' || p_partkey || '.0' AS dir, CASE WHEN p_partkey % 2 = 0 THEN 'o' ELSE 'unknown' END AS owner,
    CASE WHEN p_partkey % 2 = 0 THEN 's-' || (p_partkey % 50) ELSE p_name END AS slug, CASE WHEN p_partkey % 2 = 0 THEN '1.' || p_partkey || '.0' ELSE '1.0.0' END AS version, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS published_at,
    p_name AS name, p_type || chr(10) || '  more: of it' AS description, '# Use ' || p_brand AS text, CASE WHEN p_partkey % 3 = 0 THEN 'print(' || p_partkey || ')' END AS script FROM part WHERE p_partkey % 10 <> 9)"""


@query(f"WITH {_PACKAGES} SELECT dir, owner, slug, version, published_at, name, description, text, script, CAST(script IS NOT NULL AS INTEGER) AS scripts FROM packages")
def src11_skill_packages(spark, sf):
    s = P.skills(_tree(spark, sf))
    return s.select("dir", "owner", "slug", "version", "published_at", "name", "description", "text", F.try_element_at("scripts", F.lit("run.py")).alias("script"), F.size("scripts").alias("scripts"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 10 = 9 THEN p_name ELSE '# Use ' || p_brand END AS body FROM part")
def fn29_skill_file(spark, sf):
    p = X.dealt(X.table(spark, sf, "part"), "p_partkey")
    md = F.when(F.col("p_partkey") % 10 == 9, F.col("p_name")).otherwise(_skill_md(F.col("p_name"), F.col("p_type"), "[]", F.concat(F.lit("# Use "), "p_brand")))
    f = p.select("p_partkey", md.alias("md")).select("p_partkey", P.front_matter(F.col("md")).alias("f"), P.body(F.col("md")).alias("body"))
    return f.select("p_partkey", P.typed_value(F.try_element_at("f", F.lit("name")))["value"].alias("name"), "body")


@query("SELECT p_partkey, 'name' AS key, '''' || p_name || '''' AS value FROM part UNION ALL SELECT p_partkey, 'description', p_type || chr(10) || '  more: of it' FROM part UNION ALL SELECT p_partkey, 'metadata', '{\"own\": {\"categories\": []}}' FROM part")
def fn62_front_matter(spark, sf):
    md = _skill_md(F.col("p_name"), F.col("p_type"), "[]", F.lit("x"))
    return X.dealt(X.table(spark, sf, "part"), "p_partkey").select("p_partkey", F.explode(P.front_matter(md)))


@query(
    """SELECT p_partkey, '---' || chr(10) || 'name: ' || p_name || chr(10) || 'description: ' || p_type || chr(10) || 'metadata: ' || CASE p_partkey % 3 WHEN 0 THEN '{"own": {"complexity": "medium"}, "shown": {"mark": "*"}}'
    WHEN 1 THEN '{"own": 1, "shown": {"mark": "*"}}' ELSE '{"x": "' || p_brand || '", "shown": 2, "own": {"complexity": "medium"}}' END || chr(10) || '---' || chr(10) || chr(10) || 'Body ' || p_size AS md FROM part"""
)
def fn31_built_skill(spark, sf):
    p, n = X.table(spark, sf, "part"), F.col("p_partkey") % 3
    given = F.when(n == 1, '{"own":1}').when(n == 2, F.concat(F.lit('{"x":"'), "p_brand", F.lit('","shown":2}')))
    meta = P.with_defaults(given, {"own": '{"complexity": "medium"}', "shown": '{"mark": "*"}'})
    return p.select("p_partkey", P.built(F.col("p_name"), F.col("p_type"), F.concat(F.lit("Body "), "p_size"), meta).alias("md"))


@query("SELECT 'pkg7' AS slug, max('1.' || p_partkey || '.0') AS version FROM part WHERE p_partkey % 50 = 7")
def flt43_skill_text(spark, sf):
    return P.skill_text(_tree(spark, sf), "pkg7").select("slug", "version")


_WORDS = {"metal": ["tin", "steel", "copper"], "big": ["large", "economy"], "ring": ["ring"]}


def _letters(text):
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in "aeiou"])


def _uploaded(spark, sf, tree):
    known = X.table(spark, sf, "part").select(F.concat(F.lit("s-"), F.col("p_partkey") % 50).alias("slug"), F.concat(F.lit("1."), "p_partkey", F.lit(".0")).alias("version"), F.col("p_partkey").alias("published_at"))
    return P.uploaded(P.skills(tree), known, _WORDS, 1, "us", "$.own.categories", _letters)


_HIT = lambda ws: " + ".join(f"contains(t, '{w}')::INT" for w in ws)
_UPLOADED = f"""WITH {_PACKAGES}, newest AS (SELECT 's-' || (p_partkey % 50) AS slug, max(p_partkey) AS newest FROM part GROUP BY 1),
    u AS (SELECT p.*, lower(text || ' ' || description) AS t, CASE WHEN k = newest THEN '1.' || k || '.1' ELSE version END AS new_version FROM packages p LEFT JOIN newest n ON p.slug = n.slug)"""


@query(
    _UPLOADED
    + f""", s AS (SELECT dir, slug, new_version AS version, list_filter([{{'n': {_HIT(_WORDS['metal'])}, 'i': 0, 'c': 'metal'}}, {{'n': {_HIT(_WORDS['big'])}, 'i': 1, 'c': 'big'}}, {{'n': {_HIT(_WORDS['ring'])}, 'i': 2, 'c': 'ring'}}], lambda x: x.n > 0) AS hits,
    length(name || ' ' || description || ' ' || substring(text, 1, 500)) - length(replace(name || ' ' || description || ' ' || substring(text, 1, 500), 'a', '')) AS a FROM u)
    SELECT dir, slug, version, CASE WHEN len(hits) = 0 THEN 'general' ELSE list_reduce(hits, lambda x, y: CASE WHEN y.n > x.n THEN y ELSE x END).c END AS category, CAST(a AS DOUBLE) AS a FROM s"""
)
def api02_upload_skills(spark, sf):
    return _uploaded(spark, sf, _tree(spark, sf)).select("dir", "slug", "version", F.get("categories", F.lit(0)).alias("category"), F.get("embedding", F.lit(0)).alias("a"))


@query(
    _UPLOADED
    + """, d AS (SELECT p_partkey AS k, 'pkg' || (p_partkey % 50) || '-1.' || p_partkey || '.0' AS dir FROM part) SELECT d.dir AS path, d.dir, u.k IS NOT NULL AS success, u.new_version AS version, CASE WHEN u.k IS NULL THEN 'failed to load skill' END AS error
    FROM d LEFT JOIN u ON d.dir = u.dir WHERE d.k % 4 <> 0 UNION ALL SELECT '', d.dir, u.k IS NOT NULL, u.new_version, CASE WHEN u.k IS NULL THEN 'failed to load skill' END FROM d LEFT JOIN u ON d.dir = u.dir
    UNION ALL SELECT 'none', NULL, false, NULL, 'not a skill directory (no SKILL.md)'"""
)
def api08_upload_results(spark, sf):
    # Read five times, mostly for its paths alone.
    tree = saved(_tree(spark, sf), "tree")
    own = X.table(spark, sf, "part").where("p_partkey % 4 <> 0").select(F.concat(F.lit("pkg"), F.col("p_partkey") % 50, F.lit("-1."), "p_partkey", F.lit(".0")).alias("path"))
    paths = own.unionByName(spark.createDataFrame([("",), ("none",)], "path string"))
    return P.upload_results(paths, tree, _uploaded(spark, sf, tree)).select("path", "dir", "success", "version", "error")


def _preset_tree(spark, sf):
    p = X.dealt(X.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    name = F.when(F.col("p_partkey") % 20 == 3, "README.md").otherwise(F.concat(F.lit("n"), "p_partkey", F.lit(".md")))
    path = F.concat(F.lit("roles/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), name)
    text = F.concat(F.lit("---\nName: \""), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat("p_name", F.lit(" & "), "p_partkey")), F.lit("\"\nemoji: 'E'\nvibe: "), "p_type", F.lit("\nnot a pair\n---\n\nbody "), "p_partkey")
    return p.select(path.alias("path"), text.alias("text"))


_PRESETS = """presets AS (SELECT p_partkey, replace(p_brand, '#', '-') || '-' || trim(regexp_replace(lower(p_name || ' & ' || p_partkey), '[^a-z0-9]+', '-', 'g'), '-') AS id, replace(p_brand, '#', '-') AS category, p_name || ' & ' || p_partkey AS name, p_type AS vibe,
    'body ' || p_partkey AS body, 'roles/' || replace(p_brand, '#', '-') || '/n' || p_partkey || '.md' AS path FROM part WHERE p_partkey % 20 <> 3 AND p_partkey % 7 <> 0)"""


@query(f"WITH {_PRESETS} SELECT id, category, name, 'E' AS emoji, '' AS color, vibe, body FROM presets")
def src14_presets(spark, sf):
    return P.presets(_preset_tree(spark, sf)).select("id", "category", "name", "emoji", "color", "vibe", "body")


@query(f"WITH {_PRESETS} SELECT category AS id, replace(category, '-', ' ') AS label, list(id ORDER BY path) AS presets FROM presets GROUP BY category")
def api10_presets(spark, sf):
    return P.preset_categories(P.presets(_preset_tree(spark, sf))).select("id", "label", F.transform("presets", lambda e: e["id"]).alias("presets"))


@query("SELECT p_partkey, 'name' AS key, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || ' & ' || p_partkey END AS value, 'body ' || p_partkey AS body FROM part UNION ALL SELECT p_partkey, 'emoji', 'E', 'body ' || p_partkey FROM part UNION ALL SELECT p_partkey, 'vibe', p_type, 'body ' || p_partkey FROM part")
def fn64_lower_front_matter(spark, sf):
    t = _preset_tree(spark, sf).select(P.simple_front_matter(F.col("text"), lower=True).alias("f"))
    return t.select(F.regexp_extract("f.body", r"\d+", 0).cast("long").alias("p_partkey"), F.explode("f.meta"), "f.body")


@query("SELECT p_partkey, 'Tags' AS key, '[' || p_brand || ', ''' || p_type || ''',]' AS value, [p_brand, p_type] AS items FROM part UNION ALL SELECT p_partkey, 'name', p_name, NULL FROM part")
def fn63_listed_front_matter(spark, sf):
    text = F.concat(F.lit("---\nTags: ["), "p_brand", F.lit(", '"), "p_type", F.lit("',]\nname: x\nname: \""), "p_name", F.lit("\"\n---\nbody"))
    f = X.table(spark, sf, "part").select("p_partkey", F.explode(P.simple_front_matter(text)["meta"]))
    return f.select("p_partkey", "key", "value", P.listed(F.col("value")).alias("items"))


@query(
    """SELECT p_partkey, 'SOUL.md' AS path, '## Your Identity' || chr(10) || p_name || chr(10) || '## Communication style' || chr(10) AS text FROM part
    UNION ALL SELECT p_partkey, 'AGENTS.md', 'intro' || chr(10) || '## Work' || chr(10) || p_type || chr(10) || chr(10) || '## Tools' FROM part
    UNION ALL SELECT p_partkey, 'IDENTITY.md', CASE WHEN p_partkey % 2 = 0 THEN '# E ' || p_name || chr(10) || 'calm' || chr(10) ELSE '# ' || p_name || chr(10) || p_type || chr(10) END FROM part WHERE p_partkey % 3 <> 0"""
)
def fn36_role_files(spark, sf):
    even, named = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 != 0
    text = F.concat(F.lit("intro\n## Your Identity\n"), "p_name", F.lit("\n## Work\n"), "p_type", F.lit("\n\n## Communication style\n## Tools"))
    meta = F.map_from_arrays(F.array(*map(F.lit, ("emoji", "name", "vibe", "description"))), F.array(F.when(even & named, "E").otherwise(""), F.when(named, F.col("p_name")).otherwise(""), F.lit("calm"), F.col("p_type")))
    return X.table(spark, sf, "part").select("p_partkey", F.explode(P.role_files(meta, text)).alias("path", "text"))


@query(
    """WITH f AS (SELECT p_partkey // 4 AS k, p_partkey % 4 AS n, p_name FROM part) SELECT 's' || k AS slug, CASE n WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'en' END AS lang, p_name AS name FROM f f1
    WHERE n IN (0, 1) AND NOT (n = 1 AND EXISTS (SELECT 1 FROM f f2 WHERE f2.k = f1.k AND f2.n = 2)) UNION ALL SELECT 's' || k, 'en', p_name FROM f WHERE n = 2"""
)
def src15_showcases(spark, sf):
    n, k = F.col("p_partkey") % 4, F.floor(F.col("p_partkey") / 4)
    path = F.when(n == 0, F.concat(F.lit("zh/s"), k, F.lit(".md"))).when(n == 1, F.concat(F.lit("en/s"), k, F.lit(".md"))).when(n == 2, F.concat(F.lit("zh/s"), k, F.lit(".en.md"))).otherwise(F.concat(F.lit("zh/deep/s"), k, F.lit(".md")))
    tree = X.table(spark, sf, "part").select(path.alias("path"), F.concat(F.lit("---\nname: "), "p_name", F.lit("\ntags: [a, b]\n---\nbody")).alias("text"))
    return P.showcases(tree).select("slug", "lang", "name")


_FILES = ["AGENTS.md", "memory/x.md", "memory/deep/y.md", ".git/z.md", "skills/a/SKILL.md", "notes.txt", "skills/.b/SKILL.md", "memory/x.txt"]
_ALLOW = ["AGENTS.md", "memory/*.md", "skills/*/SKILL.md"]


@query(f"SELECT c_custkey // 8 AS agent_id, {_sql_cases('c_custkey', _FILES)} AS path, c_name AS text FROM customer WHERE c_custkey % 8 IN (0, 1, 2, 4)")
def src16_workspace_files(spark, sf):
    c = X.table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 8).alias("agent_id"), _cases("c_custkey", _FILES).alias("path"), F.col("c_name").alias("text"))
    return P.as_map(c.where(P.allowed(F.col("path"), _ALLOW)), ["agent_id"]).select("agent_id", F.explode("resources").alias("path", "text"))


@query("SELECT replace(p_name, ' ', '/') || '/' || p_partkey AS path, p_type AS text FROM part WHERE p_brand = 'Brand#2'")
def src17_default_files(spark, sf):
    tree = X.table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), "p_partkey").alias("path"), F.col("p_type").alias("text"))
    return P.as_map(P.defaults(tree, "Brand#2")).select(F.explode("resources").alias("path", "text"))


@query("SELECT '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || ' é\"}' AS value FROM part")
def snk01_json_lines(spark, sf):
    return P.json_lines(X.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" é")).alias("p_name")))


@query("SELECT 'web' AS source, CAST(strlen(html) AS BIGINT) AS size, to_base64(encode(substr(html, 1, 9))) AS head, url AS meta FROM pages")
def snk02_raw_uploads(spark, sf):
    pages = X.table(spark, sf, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"), "url")
    a = P.archived(pages, "web", F.col("url"))
    return a.select("source", "size", F.base64(F.substring("payload", 1, 9)).alias("head"), "meta")


@query("SELECT 'skill' AS source, p_name AS meta, CAST(strlen(p_type) AS BIGINT) AS size FROM part WHERE p_partkey % 3 <> 1")
def snk04_archived_skill_files(spark, sf):
    p = X.table(spark, sf, "part")
    files = p.select(_cases("p_partkey", ["a/SKILL.md", "a/.hidden/x", "a/scripts/y.py"]).alias("path"), F.encode("p_type", "UTF-8").alias("content"), "p_name")
    return P.archived(files, "skill", F.col("p_name")).select("source", "meta", "size")


_SNAP = """'{"product": "' || product || '", "resources": {"A.md": "' || display_name || '", "b/c.md": "x' || chr(92) || 'ny"}}'"""


def _workspaces(spark, sf):
    a = X.agents(spark, sf)
    resources = F.create_map(F.lit("A.md"), F.col("display_name"), F.lit("b/c.md"), F.lit("x\ny"))
    profiles = a.where("agent_id % 3 <> 0").select("user_id", "agent_id", "product", resources.alias("resources"), "revision")
    shares = a.where("agent_id % 5 = 0").select(F.col("agent_id").alias("token"), "user_id", "agent_id", F.lit("public").alias("visibility"), F.lit("old").alias("snapshot"), F.lit("code").alias("short_code"))
    return W.Workspaces(a.where("agent_id % 2 = 0").select("user_id", "agent_id", "display_name"), profiles, shares)


@query(ctes("agents") + f"SELECT agent_id, {_SNAP.replace('}}', '}, \"collected_at\": \"now\"}')} AS snapshot, product, display_name AS file FROM agents")
def fn67_snapshot(spark, sf):
    resources = F.create_map(F.lit("A.md"), F.col("display_name"), F.lit("b/c.md"), F.lit("x\ny"))
    s = X.agents(spark, sf).select("agent_id", P.snapshot_of(F.col("product"), resources, F.lit("now")).alias("snapshot"))
    back = P.from_snapshot(F.col("snapshot"))
    return s.select("agent_id", "snapshot", back["product"].alias("product"), back["resources"]["A.md"].alias("file"))


@query(
    ctes("agents")
    + f""", new AS (SELECT * FROM agents WHERE agent_id % 4 = 0) SELECT 'agent' AS what, agent_id, CASE WHEN agent_id % 2 = 0 THEN display_name ELSE '' END AS value FROM agents WHERE agent_id % 2 = 0 OR agent_id % 4 = 0
    UNION ALL SELECT 'profile', agent_id, CAST(CASE WHEN agent_id % 4 <> 0 THEN revision WHEN agent_id % 3 <> 0 THEN revision + 1 ELSE 1 END AS VARCHAR) FROM agents WHERE agent_id % 3 <> 0 OR agent_id % 4 = 0
    UNION ALL SELECT 'share', agent_id, CASE WHEN agent_id % 4 = 0 THEN {_SNAP} ELSE 'old' END FROM agents WHERE agent_id % 5 = 0"""
)
def pipe22_sync_up(spark, sf):
    resources = F.create_map(F.lit("A.md"), F.col("display_name"), F.lit("b/c.md"), F.lit("x\ny"))
    new = W.sync_up(_workspaces(spark, sf), X.agents(spark, sf).where("agent_id % 4 = 0").select("user_id", "agent_id", "product", resources.alias("resources")))
    row = lambda d, what, value: d.select(F.lit(what).alias("what"), "agent_id", F.col(value).cast("string").alias("value"))
    return row(new.agents, "agent", "display_name").unionByName(row(new.profiles, "profile", "revision")).unionByName(row(new.shares, "share", "snapshot"))


@query(
    ctes("agents")
    + f"""SELECT agent_id, CASE WHEN agent_id % 3 = 0 THEN 'no profile' WHEN agent_id % 5 = 0 THEN 'refreshed' ELSE 'created' END AS outcome, CASE WHEN agent_id % 3 <> 0 THEN {_SNAP} WHEN agent_id % 5 = 0 THEN 'old' END AS snapshot,
    CASE WHEN agent_id % 5 = 0 THEN agent_id WHEN agent_id % 3 <> 0 THEN agent_id + 1000000 END AS token FROM agents WHERE agent_id % 7 < 5"""
)
def dml42_create_shares(spark, sf):
    asked = X.agents(spark, sf).where("agent_id % 7 < 5").select("user_id", "agent_id", F.lit("public").alias("visibility"), (F.col("agent_id") + 1000000).alias("token"), F.lit("c").alias("short_code"))
    shares, told = W.create_shares(_workspaces(spark, sf), asked)
    return told.join(shares, ["user_id", "agent_id"], "left").select("agent_id", "outcome", "snapshot", "token")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'done' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE o_orderstatus END AS status FROM orders")
def dml23_training_runs(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    old = o.where("id % 2 = 0").withColumn("status", F.lit("done"))
    return W.started_runs(old, o.withColumn("status", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("status"))))


@query("SELECT 'part' AS name, count(*) AS rows_deleted, 0::BIGINT AS rows_left FROM part UNION ALL SELECT 'customer', count(*), 0 FROM customer")
def dml25_wiped(spark, sf):
    empty, counts = W.wiped({n: X.table(spark, sf, n) for n in ("part", "customer")})
    left = [t.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(n).alias("name"), "rows_left") for n, t in empty.items()]
    return counts.join(left[0].unionByName(left[1]), "name")


@query("SELECT p_partkey, [CASE WHEN p_partkey % 2 = 0 THEN 'given' WHEN contains(lower(p_type), 'tin') OR contains(lower(p_type), 'steel') OR contains(lower(p_type), 'copper') THEN 'metal' WHEN contains(lower(p_type), 'large') OR contains(lower(p_type), 'economy') THEN 'big' ELSE 'general' END] AS categories FROM part")
def udf13_suggested_categories(spark, sf):
    words = {k: v for k, v in _WORDS.items() if k != "ring"}
    p = X.table(spark, sf, "part").withColumn("t", F.concat(F.when(F.col("p_partkey") % 2 == 0, "!").otherwise(""), "p_type"))
    suggest = lambda t: F.when(F.startswith(t, F.lit("!")), F.array(F.lit("given")))
    return p.select("p_partkey", F.slice(T.categories(F.col("t"), words, suggest), 1, 1).alias("categories"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['a', 'b'] ELSE [] END AS tags, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS dims FROM documents")
def prj03_decoded_rows(spark, sf):
    n = F.col("doc_id") % 3
    raw = F.when(n == 0, '["a","b"]').when(n == 1, "{bad")
    vector = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0)))
    return X.table(spark, sf, "documents").select("doc_id", K.decoded_tags(raw).alias("tags"), F.size(K.decoded_vector(vector)).alias("dims"))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 64 END AS dims FROM embeddings")
def fn60_record_vector(spark, sf):
    v = X.table(spark, sf, "embeddings").withColumn("e", F.when(F.col("vec_id") % 4 != 0, F.col("embedding")))
    return v.select("vec_id", F.size(K.decoded_vector(F.col("e"))).alias("dims"))
