"""Pipelines over the operators, and the plans that need more than SQL: queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions import messages as M
from sparkloom.functions import quality
from sparkloom.functions import sections as S
from sparkloom.functions import text as T
from sparkloom.operators import aggregates as A
from sparkloom.operators import knowledge as K
from sparkloom.operators import lookup as L
from sparkloom.operators import search as Q
from sparkloom.operators import similarity as V
from sparkloom.plans.evolution import WINDOWS_SQL
from sparkloom.plans.registry import cut_sql, query, strip_sql
from sparkloom.sources import fixtures as X
from sparkloom.sources import packages as P
from sparkloom.sources import sessions as J
from sparkloom.sources.fixtures import ctes


def _lines(spark, sf):
    """Sessions as JSON lines: those with an even id in plain content, the others in blocks."""
    c = X.table(spark, sf, "conversations")
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    blocks = F.to_json(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))
    return c.select(F.col("conv_id").alias("session"), (F.col("turn") + 1).alias("line_no"), F.when(F.col("conv_id") % 2 == 0, plain).otherwise(blocks).alias("raw"))


_MADE = "CASE WHEN doc_id % 4 = 0 THEN doc_id % 5 END"


@query(f"SELECT count(*) AS total_files, count(*) FILTER (WHERE length(text) <= 2000) AS successful, CAST(sum(CASE WHEN length(text) > 2000 THEN 0 WHEN {_MADE} > 0 THEN {_MADE} WHEN doc_id % 6 = 1 THEN 7 WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_memories FROM documents")
def src03_ingest_totals(spark, sf):
    """Documents as session files: some gave memories, some of those none, some have another counter, the rest count where they are new."""
    d = X.table(spark, sf, "documents")
    name = F.concat("doc_id", F.lit(".jsonl"))
    known = d.where("doc_id % 3 = 0").select(F.col("source").alias("agent_id"), name.alias("session_file"))
    files = d.select("source", name.alias("session"), F.length("text").cast("long").alias("size"), "text")
    made = d.select(name.alias("session_file"), F.expr(_MADE).alias("memories_uploaded"), F.expr("CASE WHEN doc_id % 6 = 1 THEN 7 ELSE 0 END").alias("total_uploaded"))
    return J.ingest_totals(J.ingested(files, F.col("source"), known, cap=2000).join(made, "session_file"))


_READ = f"SELECT source AS agent_id, doc_id || '.jsonl' AS session_file, doc_id, length(text) AS size, CASE WHEN {strip_sql('text')} = '' THEN [] ELSE string_split({strip_sql('text')}, chr(10)) END AS l FROM documents"


def _read_on(spark, sf):
    """Of every three files one is unread, one has grown since its first line was read, and one is as it was."""
    d = X.table(spark, sf, "documents").withColumn("session", F.concat("doc_id", F.lit(".jsonl")))
    files = d.select("source", "session", F.length("text").cast("long").alias("size"), "text")
    size = F.length("text").cast("long")
    progress = d.where("doc_id % 3 <> 0").select(F.col("source").alias("agent_id"), F.col("session").alias("session_file"), F.lit(1).cast("long").alias("lines"), F.when(F.col("doc_id") % 3 == 1, size - 1).otherwise(size).alias("size"))
    return J.read_on(files, F.col("source"), progress)


@query(f"SELECT agent_id, session_file, i AS line_no, l[i] AS raw FROM (SELECT *, unnest(range(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END, len(l) + 1)) AS i FROM ({_READ}) WHERE doc_id % 3 <> 2)")
def src02_appended_lines(spark, sf):
    return _read_on(spark, sf)[0]


@query(f"SELECT agent_id, session_file, CAST(CASE WHEN doc_id % 3 = 2 THEN 1 ELSE len(l) END AS BIGINT) AS lines, size FROM ({_READ})")
def flt37_progress_after_reading(spark, sf):
    return _read_on(spark, sf)[1]


@query(f"SELECT doc_id AS session, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split({strip_sql('text')}, chr(10)) AS l FROM documents)")
def src05_session_lines(spark, sf):
    return J.lines(X.table(spark, sf, "documents").select(F.col("doc_id").alias("session"), "text"))


@query(ctes("messages") + ", s AS (SELECT DISTINCT session AS id, session, 2 AS a, 3 AS b FROM messages) SELECT s.id, m.msg_idx, m.role FROM s JOIN messages m ON s.session = m.session AND m.msg_idx BETWEEN a AND b")
def src06_segment_messages(spark, sf):
    m = X.messages(spark, sf)
    seg = m.select("session").distinct().select(F.col("session").alias("id"), "session", F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return J.slices(seg, m).select("id", "msg_idx", "role")


@query("SELECT DISTINCT conv_id AS session, CASE WHEN conv_id % 2 = 0 THEN 'plain' ELSE 'blocks' END AS dialect FROM conversations")
def src07_dialect(spark, sf):
    return J.dialects(_lines(spark, sf))


@query("""SELECT conv_id AS session, turn + 1 AS msg_idx, role, """ + strip_sql("text") + """ AS body FROM conversations WHERE conv_id % 2 = 0""")
def src08_plain_dialect(spark, sf):
    return J.messages(_lines(spark, sf).where("session % 2 = 0")).select("session", "msg_idx", "role", "body")


@query("""SELECT conv_id AS session, turn + 1 AS msg_idx, role, """ + strip_sql("text") + """ AS body FROM conversations WHERE conv_id % 2 = 1""")
def src09_block_dialect(spark, sf):
    return J.messages(_lines(spark, sf).where("session % 2 = 1")).select("session", "msg_idx", "role", "body")


@query("SELECT conv_id AS session, turn + 1 AS msg_idx, role FROM conversations WHERE " + strip_sql("text") + " <> ''")
def src10_trajectory_messages(spark, sf):
    return J.messages(_lines(spark, sf)).select("session", "msg_idx", "role")


_DIR = "CASE p_partkey % 3 WHEN 0 THEN p_brand || '-1.' || p_size WHEN 1 THEN p_brand || '-x' ELSE 'plain' END"


def _dirs(spark, sf):
    n = F.col("p_partkey") % 3
    return X.table(spark, sf, "part").select("p_partkey", F.when(n == 0, F.concat("p_brand", F.lit("-1."), "p_size")).when(n == 1, F.concat("p_brand", F.lit("-x"))).otherwise(F.lit("plain")).alias("dir"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE {_DIR} END AS slug, CASE WHEN p_partkey % 3 = 0 THEN '1.' || p_size ELSE '1.0.0' END AS version FROM part")
def src12_skill_directories(spark, sf):
    slug, version = P.slug_and_version(F.col("dir"))
    return _dirs(spark, sf).select("p_partkey", slug.alias("slug"), version.alias("version"))


@query(ctes("skills") + "SELECT DISTINCT version FROM skills WHERE starts_with(slug, '17') ORDER BY version DESC")
def src13_versions_of_slug(spark, sf):
    return X.skills(spark, sf).where(F.startswith("slug", F.lit("17"))).select("version").distinct().orderBy(F.col("version").desc())


@query(ctes("native").replace("WITH ", "WITH RECURSIVE ", 1) + WINDOWS_SQL(2000) + ' SELECT session, msg_idx, role, win AS "window", body AS text FROM packed')
def win06_token_windows(spark, sf):
    return M.windows(X.native(spark, sf), ["session"], 2000)


@query(
    ctes("native")
    + f""", m AS (SELECT *, length(role) + length(body) + 4 AS n FROM shown WHERE body <> ''), u AS (SELECT *, 800 - coalesce(sum(n) OVER (PARTITION BY session ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM m),
    l AS (SELECT session, msg_idx, CASE WHEN n <= rest THEN '[' || role || ']: ' || body WHEN rest - length(role) - 4 > 0 THEN '[' || role || ']: ' || nullif({cut_sql('body', 'CAST(rest - length(role) - 4 AS BIGINT)')}, '') END AS line FROM u)
    SELECT session, string_agg(line, chr(10) ORDER BY msg_idx) AS text FROM l WHERE line IS NOT NULL GROUP BY session"""
)
def win07_within_budget(spark, sf):
    return M.within_budget(X.native(spark, sf), ["session"], 800)


def _files(spark, sf):
    """A user's file whose section A holds a whole text in every second row, the default it came from, and a new default."""
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    md = lambda a, b, extra: F.concat(F.lit("intro\n## A\n"), a, F.lit("\n## B\n"), b, extra)
    odd = F.col("doc_id") % 2 == 1
    user = md(F.when(odd, F.col("text")).otherwise(F.lit("same")), F.lit("b"), F.when(F.col("doc_id") % 3 == 0, F.lit("\n## C\nown")).otherwise(F.lit("")))
    return d.select("doc_id", user.alias("user"), md(F.lit("same"), F.lit("b"), F.lit("")).alias("source"), F.lit("hello\n## A\nnew a\n## B\nnew b").alias("target"))


@query(
    "SELECT doc_id, '' AS title, 'unchanged' AS kind FROM documents UNION ALL SELECT doc_id, '## A', CASE WHEN doc_id % 2 = 1 THEN 'modified' ELSE 'unchanged' END FROM documents UNION ALL SELECT doc_id, '## B', 'unchanged' FROM documents UNION ALL SELECT doc_id, '## C', 'added' FROM documents WHERE doc_id % 3 = 0"
)
def set05_section_difference(spark, sf):
    f = _files(spark, sf)
    return f.select("doc_id", F.explode(S.compared(S.parsed(F.col("user")), S.parsed(F.col("source")))).alias("s")).select("doc_id", "s.title", "s.kind")


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {strip_sql('x')} <> '' AND NOT list_contains(['intro', '## A', 'same', '## B', 'b'], {strip_sql('x')})) AS own FROM documents)
    SELECT doc_id, {strip_sql("concat_ws(chr(10), CASE WHEN doc_id % 2 = 1 AND len(own) > 0 THEN array_to_string(own, chr(10)) END, CASE WHEN doc_id % 3 = 0 THEN '## C' || chr(10) || 'own' END)")} AS diff FROM l"""
)
def set06_user_lines(spark, sf):
    return _files(spark, sf).select("doc_id", S.user_lines(F.col("user"), F.col("source")).alias("diff"))


@query(
    "SELECT doc_id, 'hello' || chr(10) || '## A' || chr(10) || CASE WHEN doc_id % 2 = 1 THEN text ELSE 'new a' END || chr(10) || '## B' || chr(10) || 'new b' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '## C' || chr(10) || 'own' ELSE '' END AS merged FROM documents"
)
def pipe18_merged_sections(spark, sf):
    return _files(spark, sf).select("doc_id", S.merged(F.col("user"), F.col("source"), F.col("target")).alias("merged"))


@query(
    "SELECT doc_id, chr(10) || '## Active Tasks' || chr(10) || 'keep' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'mine' || chr(10) || 'mine' || chr(10) ELSE '' END || '<!-- end -->' AS merged FROM documents"
)
def pipe19_merged_tasks(spark, sf):
    d = X.table(spark, sf, "documents")
    user = F.concat(F.lit("## Active Tasks\nkeep\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("mine\n")).otherwise(F.lit("")), F.lit("<!-- end -->"))
    base = F.lit("## Active Tasks\nkeep\n<!-- end -->")
    # A changed section is taken whole and its new lines are put in as well, so they stand there twice.
    return d.select("doc_id", S.merged_tasks(user, base, base).alias("merged"))


@query("SELECT p_brand AS category, string_agg(p_name, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand")
def pipe21_role_resources(spark, sf):
    return K.concatenated(X.table(spark, sf, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("text")), ["category"])


@query(
    ctes("memories")
    + """SELECT id, CASE WHEN id % 2 = 0 THEN ['lang:' || context, 'src:' || resolution, 'Extra'] ELSE tags END AS tags FROM memories"""
)
def pipe02_merged_tags(spark, sf):
    m = X.memories(spark, sf).select("id", "tags")
    new = m.where("id % 2 = 0").select("id", F.array(F.lit("Extra "), F.lit("EXTRA")).alias("incoming"))
    return K.merge_tags(m, new)


_MERGES = """, p AS (SELECT a.id AS ia, b.id AS ib, a.hit_count AS ha, b.hit_count AS hb, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS sim FROM vectors a JOIN vectors b
    ON a.memory_type = b.memory_type AND a.id < b.id WHERE a.status <> 'archived' AND b.status <> 'archived'),
    q AS (SELECT CASE WHEN ha >= hb THEN ia ELSE ib END AS winner, CASE WHEN ha >= hb THEN ib ELSE ia END AS loser, sim FROM p WHERE sim >= {soft}),
    r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, winner, loser) AS i FROM q WHERE {fit}),
    g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS lost, false AS ok, NULL::BIGINT AS winner, NULL::BIGINT AS loser, NULL::DOUBLE AS sim
    UNION ALL SELECT r.i, CASE WHEN list_contains(lost, r.winner) OR list_contains(lost, r.loser) THEN lost ELSE list_append(lost, r.loser) END, NOT (list_contains(lost, r.winner) OR list_contains(lost, r.loser)), r.winner, r.loser, r.sim
    FROM g JOIN r ON r.i = g.i + 1 WHERE len(lost) < {most}), merges AS (SELECT winner, loser, sim, i FROM g WHERE ok)"""
_SOFT = {"soft": 0.3, "most": DEFAULTS.consolidate_most}


def _pairs(spark, sf):
    return V.consolidation_pairs(X.vectors(spark, sf), 0.29).withColumn("sim", F.round("sim", 6)).where("sim >= 0.3")


@query(ctes("vectors").replace("WITH ", "WITH RECURSIVE ", 1) + _MERGES.format(fit="sim >= 0.4 OR (winner + loser) % 3 > 0", **_SOFT) + " SELECT winner, loser, sim FROM merges")
def pipe03_consolidation(spark, sf):
    fit = K.mergeable(_pairs(spark, sf), 0.4, confirm=(F.col("winner") + F.col("loser")) % 3 > 0)
    return K.greedy_merges(fit, DEFAULTS.consolidate_most)


@query(ctes("vectors").replace("WITH ", "WITH RECURSIVE ", 1) + _MERGES.format(fit="sim >= 0.35", soft=0.3, most=100000) + " SELECT winner, loser, sim FROM merges")
def pipe03_dry_run(spark, sf):
    return K.greedy_merges(K.mergeable(_pairs(spark, sf), 0.35, dry_run=True))


@query(
    ctes("memories", "vectors").replace("WITH ", "WITH RECURSIVE ", 1)
    + _MERGES.format(fit="true", **_SOFT)
    + f""", b AS (SELECT m.i, m.winner, m.loser, w.content AS wc, {strip_sql('w.content')} AS a, {strip_sql('l.content')} AS b, w.context AS wx, l.context AS lx, w.resolution AS wr, l.resolution AS lr, w.tags || l.tags AS tags, l.hit_count AS lh FROM merges m JOIN memories w ON w.id = m.winner JOIN memories l ON l.id = m.loser),
    f AS (SELECT *, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS fa, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS fb FROM b),
    k AS (SELECT *, CASE WHEN a = '' THEN b WHEN contains(fa, fb) OR contains(a, b) THEN a WHEN contains(fb, fa) OR contains(b, a) THEN b WHEN length(a) + length(b) > 6553 THEN CASE WHEN length(a) >= length(b) THEN a ELSE b END
    ELSE a || chr(10) || chr(10) || '---' || chr(10) || chr(10) || b END AS x FROM f),
    n AS (SELECT *, CASE WHEN b = '' THEN a ELSE {cut_sql('x', 8192)} END AS nc, CASE WHEN contains(wx, lx) THEN wx ELSE wx || chr(10) || chr(10) || '---' || chr(10) || chr(10) || lx END AS nx,
    CASE WHEN contains(wr, lr) THEN wr ELSE wr || chr(10) || chr(10) || '---' || chr(10) || chr(10) || lr END AS nr FROM k),
    d AS (SELECT *, CASE WHEN nc = '' THEN wc ELSE nc END AS fc FROM n), c AS (SELECT * FROM d WHERE fc <> wc OR nx <> wx OR nr <> wr),
    won AS (SELECT winner, count(*) FILTER (WHERE lh > 0) AS hits, arg_max(fc, i) AS content, arg_max(nx, i) AS context, arg_max(tags, i) AS tags FROM c GROUP BY winner)
    SELECT m.id, m.hit_count + coalesce(hits, 0) AS hit_count, CASE WHEN id IN (SELECT loser FROM c) THEN 'archived' ELSE status END AS status, coalesce(won.content, m.content) AS content, coalesce(won.context, m.context) AS context,
    len(list_distinct(coalesce(won.tags, m.tags))) AS tags FROM memories m LEFT JOIN won ON won.winner = m.id"""
)
def pipe04_apply_merges(spark, sf):
    m = X.memories(spark, sf).drop("created_at")
    done = K.apply_merges(m, K.greedy_merges(_pairs(spark, sf), DEFAULTS.consolidate_most), K.rule_merger)
    return done.select("id", "hit_count", "status", "content", "context", F.size("tags").cast("long").alias("tags"))


@query("SELECT doc_id AS id, round(least(1.0, length(text) / 200.0), 4) AS score, true AS labeled FROM documents")
def pipe08_label_segments(spark, sf):
    done = K.label(X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return done.select("id", F.round(quality.score(F.col("quality_metrics")), 4).alias("score"), "labeled")


_RENDERED = """'<tool_call>' || chr(10) || '<function=look>' || chr(10) || '<parameter=n>' || chr(10) || msg_idx || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>'"""
_TRAIN = f"""t AS (SELECT session, msg_idx, role || '|' || CASE WHEN calls IS NULL THEN content WHEN said = '' THEN {_RENDERED} ELSE content || chr(10) || chr(10) || {_RENDERED} END || '|' || CASE WHEN thinks THEN reason ELSE '' END AS m FROM shown WHERE body IS NOT NULL)"""


def _exported(spark, sf, sessions):
    m = X.native(spark, sf).where("body IS NOT NULL")
    seg = sessions.select(F.col("session").alias("id"), "session", F.lit(1).alias("start_line"), "end_line")
    line = lambda e: F.concat(e["role"], F.lit("|"), e["content"], F.lit("|"), F.coalesce(e["reasoning_content"], F.lit("")))
    return K.sft_export(seg, m).select("id", F.transform("messages", line).alias("messages"))


def _all_sessions(spark, sf):
    return X.messages(spark, sf).groupBy("session").agg(F.max("msg_idx").alias("end_line"))


@query(ctes("native") + f", {_TRAIN} SELECT session AS id, list(m ORDER BY msg_idx) AS messages FROM t GROUP BY session HAVING count(*) >= 2")
def pipe10_sft_export(spark, sf):
    return _exported(spark, sf, _all_sessions(spark, sf))


@query(
    ctes("native")
    + f""", {_TRAIN}, s AS (SELECT DISTINCT session, TIMESTAMP '2024-01-01' + to_hours(session) AS created_at, (session % 100) / 100.0 AS score FROM native),
    e AS (SELECT session FROM s WHERE score >= 0.8 AND created_at > TIMESTAMP '2024-01-03' ORDER BY created_at, session LIMIT 5000) SELECT session AS id, list(m ORDER BY msg_idx) AS messages FROM t WHERE session IN (SELECT session FROM e) GROUP BY session HAVING count(*) >= 2"""
)
def pipe11_sft_export_since(spark, sf):
    score = F.concat(F.lit('{"summary":{"overall_score":'), (F.col("session") % 100) / 100, F.lit("}}"))
    hours = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(session as int), 0, 0)")
    s = _all_sessions(spark, sf).withColumns({"quality_metrics": score, "labeled": F.lit(True), "created_at": hours})
    fit = A.eligible(s, DEFAULTS.sft_score, since=F.lit("2024-01-03").cast("timestamp_ntz"))
    return _exported(spark, sf, L.newest(fit, "created_at", "session", 5000, oldest=True))


@query(ctes("segments") + "SELECT count(*) >= 100 AS trigger FROM segments WHERE labeled AND score >= 0.8")
def pipe12_should_trigger(spark, sf):
    return A.eligible(X.segments(spark, sf), DEFAULTS.sft_score).agg((F.count(F.lit(1)) >= DEFAULTS.sft_trigger).alias("trigger"))


@query(ctes("evolutions") + ", e AS (SELECT *, lag(new_score) OVER (PARTITION BY cluster_id ORDER BY timestamp, id) AS old_score FROM evolutions) SELECT id, CASE WHEN old_score IS NULL THEN 'crystallized' WHEN new_score > old_score THEN 'recrystallized' ELSE 'revert' END AS outcome FROM e")
def pipe15_upgrade_gate(spark, sf):
    return K.upgrade_gate(X.evolutions(spark, sf)).select("id", "outcome")


_HEX = lambda k: f"(strpos('0123456789abcdef', substr(h, {k}, 1)) - 1)"


@query(
    f"""WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS h FROM documents),
    s AS (SELECT doc_id, ({_HEX(3)} * 16 + {_HEX(4)}) % 32 AS d, CAST(sum(CASE WHEN {_HEX(6)} % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM w GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM s GROUP BY doc_id),
    f AS (SELECT doc_id, i, coalesce(x / nullif(n, 0), 0) AS x FROM documents CROSS JOIN (SELECT unnest(range(32)) AS i) LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id) WHERE s.d = i OR s.d IS NULL
        UNION ALL SELECT doc_id, i, 0 FROM documents CROSS JOIN (SELECT unnest(range(32)) AS i) WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = documents.doc_id) AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = documents.doc_id AND s.d = i))
    SELECT doc_id, list(round(x, 4) ORDER BY i) AS embedding FROM f GROUP BY doc_id"""
)
def udf01_hash_embedding(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.transform(K.embed(F.col("text"), 32), lambda x: F.round(x, 4)).alias("embedding"))


@query(f"SELECT conv_id, turn, [{strip_sql('text')}] AS phrases FROM conversations")
def udf12_query_phrases(spark, sf):
    """Without an analyzer a query is its own only phrase."""
    return X.table(spark, sf, "conversations").select("conv_id", "turn", Q.phrases(F.col("text")).alias("phrases"))
