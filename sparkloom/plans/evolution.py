"""Extraction, crystallisation and what models do for them, with plain stand-ins: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions import text as T
from sparkloom.operators import clusters as C
from sparkloom.operators import evolution as E
from sparkloom.operators import extraction as Q
from sparkloom.operators import knowledge as K
from sparkloom.plans.registry import cut_sql, flat_sql, query, strip_sql
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import ctes
from sparkloom.streaming import maintenance


def digits(text):
    """An embedder that SQL can say as well: the hexadecimal digits of the text's MD5 around zero."""
    return T.let(F.md5(text), lambda h: F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("double") - 7.5))


DIGITS_SQL = "list_transform(range(1, 33), lambda i: strpos('0123456789abcdef', substr(md5({t}), i, 1)) - 8.5)"
_any = lambda words, t: "(" + " OR ".join("contains(" + t + ", '" + w.replace("'", "''") + "')" for w in words) + ")"


def clean_sql(text: str) -> str:
    """DuckDB text of functions.text.sanitize."""
    for p, r in T.PATH_PATTERNS + T.CREDENTIAL_PATTERNS + T.PII_PATTERNS:
        text = f"regexp_replace({text}, '{p.replace(chr(39), chr(39) * 2)}', '{r}', 'gi')"
    digit = "CAST(substr(regexp_replace(c, '[ -]', '', 'g'), i, 1) AS INTEGER)"
    valid = f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN 2 * {digit} % 10 + 2 * {digit} // 10 ELSE {digit} END)) % 10 = 0"
    cards = f"list_filter(regexp_extract_all({text}, '{T.CARD_PATTERN}'), lambda c: {valid})"
    return f"list_reduce(list_prepend({text}, {cards}), lambda a, c: replace(a, c, '{T.CARD_MARK}'))"


def upload_sql(new: str, old: str, order: str = "new_id", confirm: str = "false", hard: float = 0.85) -> str:
    """DuckDB CTEs that end in `up`: what knowledge.upload() makes of `new` (new_id, content, context, resolution) against `old`, row after row."""
    blob = "lower(concat_ws(chr(10), content, context, resolution))"
    put = lambda k: f"'memory type: ' || {k} || ' content: ' || substring(content, 1, 300) || ' context: ' || substring(context, 1, 200) || ' resolution: ' || substring(resolution, 1, 200)"
    return f"""clean AS (SELECT * REPLACE ({clean_sql('content')} AS content, {clean_sql('context')} AS context, {clean_sql('resolution')} AS resolution) FROM {new}),
    kinds AS (SELECT *, CASE WHEN {_any(T.SECURITY_MARKERS, 'b')} THEN 'security' WHEN {_any(T.ERROR_MARKERS, 'b')} THEN 'error' ELSE 'pattern' END AS memory_type FROM (SELECT *, {blob} AS b FROM clean)),
    nv AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS place, {DIGITS_SQL.format(t=put('memory_type'))} AS v FROM kinds), ov AS (SELECT *, {DIGITS_SQL.format(t=put('memory_type'))} AS v FROM {old} WHERE status <> 'archived'),
    cand AS (SELECT nv.place, ov.id, NULL::BIGINT AS other, CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END AS t, ov.content AS said, round(list_cosine_similarity(nv.v, ov.v), 9) AS sim FROM nv JOIN ov USING (memory_type)
        UNION ALL SELECT a.place, NULL, b.place, 3, b.content, round(list_cosine_similarity(a.v, b.v), 9) FROM nv a JOIN nv b ON a.memory_type = b.memory_type AND b.place < a.place),
    lists AS (SELECT place, list({{'id': id, 'other': other, 'yes': coalesce(sim >= {hard} OR {confirm.format(said='said')}, false)}} ORDER BY sim DESC, t, coalesce(id, other)) AS c FROM cand WHERE sim >= 0.75 GROUP BY place),
    turns AS MATERIALIZED (SELECT nv.place, c FROM nv LEFT JOIN lists USING (place)),
    taken AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS ins, NULL::VARCHAR AS action, NULL::BIGINT AS id, NULL::BIGINT AS other
        UNION ALL SELECT place, CASE WHEN merges THEN ins ELSE list_append(ins, place) END, CASE WHEN merges THEN 'merge' ELSE 'insert' END, best.id, best.other FROM (
            SELECT *, coalesce(best.yes, false) AS merges FROM (
            SELECT turns.place, ins, list_filter(c, lambda x: x.other IS NULL OR list_contains(ins, x.other))[1] AS best FROM taken JOIN turns ON turns.place = taken.place + 1))),
    up AS (SELECT nv.*, taken.action, CASE WHEN taken.action = 'merge' THEN taken.id END AS duplicate_of, CASE WHEN taken.action = 'merge' THEN e.new_id END AS duplicate_of_new
        FROM nv JOIN taken USING (place) LEFT JOIN nv e ON e.place = taken.other)"""


#: DuckDB CTE of one cluster after the other: rows(k, i, id, v) of each k in order of i, from no clusters.
LEADERS_SQL = """leaders AS (SELECT DISTINCT k, 0::BIGINT AS i, []::STRUCT(id BIGINT, s DOUBLE[])[] AS c, NULL::BIGINT AS id, NULL::BIGINT AS cluster_id FROM {rows}
    UNION ALL SELECT k, i, CASE WHEN joins THEN list_concat(list_append(c[1:pos - 1], {{'id': c[pos].id, 's': list_transform(list_zip(c[pos].s, v), lambda x: x[1] + x[2])}}), c[pos + 1:]) ELSE list_append(c, {{'id': id, 's': v}}) END,
        id, CASE WHEN joins THEN c[pos].id ELSE id END FROM (SELECT *, coalesce(list_max(sims) >= 0.3, false) AS joins, list_position(sims, list_max(sims)) AS pos FROM (
        SELECT g.k, r.i, r.id, r.v, g.c, list_transform(g.c, lambda x: round(list_cosine_similarity(x.s, r.v), 12)) AS sims FROM leaders g JOIN {rows} r ON r.k = g.k AND r.i = g.i + 1)))"""


_OLD = "old AS (SELECT id, CASE id % 3 WHEN 0 THEN memory_type ELSE 'pattern' END AS memory_type, tier, status, content, context, resolution FROM memories WHERE id % 10 <> 0)"


def _split(spark, sf, new_more=(), old_more=()):
    m = X.memories(spark, sf)
    new = m.where("id % 10 = 0").select(F.col("id").alias("new_id"), "content", "context", "resolution", *new_more)
    old = m.where("id % 10 <> 0").withColumn("memory_type", F.when(F.col("id") % 3 == 0, F.col("memory_type")).otherwise("pattern"))
    return new, old.select("id", "memory_type", "tier", "status", "content", "context", "resolution", *old_more)


_NEW = "new AS (SELECT id AS new_id, content, context, resolution, tags FROM memories WHERE id % 10 = 0)"
_UPLOAD = ctes("memories").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_NEW}, {_OLD}, "


@query(_UPLOAD + upload_sql("new", "old") + " SELECT new_id, memory_type, action, duplicate_of, duplicate_of_new FROM up")
def pipe01_upload(spark, sf):
    new, old = _split(spark, sf)
    return K.upload(new, old, embedder=digits).select("new_id", "memory_type", "action", "duplicate_of", "duplicate_of_new")


@query(
    _UPLOAD + upload_sql("new", "old") + ", own AS (SELECT 'all' AS k, row_number() OVER (ORDER BY new_id) AS i, new_id AS id, v FROM up WHERE action = 'insert'), " + LEADERS_SQL.format(rows="own")
    + " SELECT id, cluster_id FROM leaders WHERE id IS NOT NULL"
)
def pipe01_clusters(spark, sf):
    """The memories that an upload inserts, each to the cluster that it joins or founds."""
    new, old = _split(spark, sf)
    up = K.upload(new, old, embedder=digits)
    return C.leader_clusters(up.where("action = 'insert'").select(F.col("new_id").alias("id"), "embedding"), 0.3).assigned


def _tagged(spark, sf):
    """(memories, upload) with tags and hits."""
    new, known = _split(spark, sf, ["tags"], ["tags", "hit_count", "last_hit_at"])
    return known, K.upload(new, known, embedder=digits)


def _completed(spark, sf, merger=None):
    return K.complete_uploads(*_tagged(spark, sf), X.AS_OF, merger)


_AFTER = """, base AS (SELECT o.id, o.content, m.tags, m.hit_count, m.last_hit_at FROM old o JOIN memories m USING (id) UNION ALL SELECT new_id, content, tags, 1, TIMESTAMP '2024-02-01' FROM up WHERE action = 'insert'),
    hit AS (SELECT coalesce(duplicate_of, duplicate_of_new) AS id, new_id AS seq, content, tags FROM up WHERE action = 'merge'), n AS (SELECT id, count(*) AS hits FROM hit GROUP BY id),
    e AS (SELECT id, -1 AS seq, unnest(tags) AS t, unnest(range(len(tags))) AS pos FROM base UNION ALL SELECT id, seq, unnest(tags), unnest(range(len(tags))) FROM hit),
    f AS (SELECT id, arg_min(t, (seq, pos)) AS t, min((seq, pos)) AS p FROM e GROUP BY id, lower(t)), l AS (SELECT id, list(t ORDER BY p)[1:10] AS tags FROM f GROUP BY id)"""


@query(_UPLOAD + upload_sql("new", "old") + _AFTER + " SELECT base.id, hit_count + coalesce(hits, 0) AS hit_count, CASE WHEN hits > 0 THEN TIMESTAMP '2024-02-01' ELSE last_hit_at END AS last_hit_at, l.tags FROM base LEFT JOIN n USING (id) LEFT JOIN l USING (id)")
def pipe02_completed(spark, sf):
    """Memories after an upload: those inserted, and hits and tags of those that took a near-duplicate."""
    return _completed(spark, sf).select("id", "hit_count", "last_hit_at", "tags")


@query(_UPLOAD + upload_sql("new", "old") + " SELECT coalesce(duplicate_of, duplicate_of_new) AS memory_id, content, context, resolution, TIMESTAMP '2024-02-01' AS contributed_at FROM up WHERE action = 'merge' AND (content <> '' OR resolution <> '')")
def pipe02_contributions(spark, sf):
    return K.contributions(_tagged(spark, sf)[1], X.AS_OF)


@query(_UPLOAD + upload_sql("new", "old") + _AFTER + ", s AS (SELECT id, string_agg(length(content), '+' ORDER BY seq) AS more FROM hit GROUP BY id) SELECT base.id, CASE WHEN more IS NULL THEN content ELSE length(content) || '+' || more END AS content FROM base LEFT JOIN s USING (id)")
def pipe02_merged_texts(spark, sf):
    """A merger that tells the lengths of what it merged, so that the order of the merges shows."""
    size = lambda c: F.when(c.rlike(r"^\d+(\+\d+)*$"), c).otherwise(F.length(c).cast("string"))
    merger = lambda old, new: F.struct(F.concat_ws("+", size(old[0]), F.length(new[0])).alias("content"), old[1].alias("context"), old[2].alias("resolution"))
    return _completed(spark, sf, merger).select("id", "content")


@query(_UPLOAD + upload_sql("new", "old", confirm="length({said}) % 2 = 0", hard=1.1) + " SELECT new_id, action FROM up")
def udf03_confirmed_duplicates(spark, sf):
    new, old = _split(spark, sf)
    up = K.upload(new, old, hard=1.1, embedder=digits, confirm=lambda content, context, own, own_context: F.length(content) % 2 == 0)
    return up.select("new_id", "action")


_TEXTS = f"""t AS (SELECT '/data/' || lang || '/' || doc_id || '.txt' AS source_file, doc_id, text FROM documents WHERE {strip_sql('text')} <> '')"""


@query(
    ctes("memories").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {_TEXTS}, new AS (SELECT doc_id AS new_id, source_file, split_part({strip_sql('text')}, chr(10), 1) AS content, '' AS context, '' AS resolution FROM t), {_OLD}, {upload_sql('new', 'old', 'source_file')}
    SELECT '/data/' || lang || '/' || new_id || '.txt' AS source_file, up.content, ['source:' || new_id || '.txt'] AS tags, memory_type, action FROM up JOIN documents ON doc_id = new_id WHERE {strip_sql('up.content')} <> ''"""
)
def src04_ingest_texts(spark, sf):
    texts = X.table(spark, sf, "documents").select(F.concat(F.lit("/data/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("source_file"), "text")
    return Q.ingest_texts(texts, _split(spark, sf)[1], embedder=digits).select("source_file", "content", "tags", "memory_type", "action")


def _sessions(spark, sf):
    m = X.native(spark, sf)
    last = m.groupBy("session").agg(F.max("msg_idx").alias("end_line"))
    score = F.concat(F.lit('{"summary":{"overall_score":'), (F.col("session") % 11) / 10, F.lit(',"task_type":"'), F.when(F.col("session") % 2 == 0, "code").otherwise(""), F.lit('"}}'))
    return last.select(
        F.col("session").alias("id"), "session", F.lit(1).alias("start_line"), "end_line", F.when(F.col("session") % 3 != 0, F.concat(F.repeat(F.lit("topic "), 8), "session")).otherwise("").alias("topic"),
        F.when(F.col("session") % 5 != 0, F.concat(F.lit("agent"), F.col("session") % 4)).alias("agent_id"), score.alias("quality_metrics"), (F.col("session") % 7 != 0).alias("labeled"), (F.col("session") % 4 == 0).alias("memory_extracted"),
    )


_WINDOWED = """, m AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY msg_idx) AS i, msg_idx, role, body, length(role) + length(body) + 4 AS n FROM shown WHERE body <> ''),
    w AS (SELECT session, i, n AS used, 0 AS win FROM m WHERE i = 1 UNION ALL SELECT m.session, m.i, CASE WHEN w.used + 1 + m.n <= {most} THEN w.used + 1 + m.n ELSE m.n END, CASE WHEN w.used + 1 + m.n <= {most} THEN w.win ELSE w.win + 1 END
    FROM w JOIN m ON m.session = w.session AND m.i = w.i + 1), packed AS (SELECT m.session, msg_idx, role, win, CASE WHEN n > {most} THEN {cut} ELSE body END AS body FROM m JOIN w USING (session, i))"""
WINDOWS_SQL = lambda most: _WINDOWED.replace("{most}", str(most)).replace("{cut}", cut_sql("body", f"{most} - length(role) - 4"))


@query(
    ctes("native", "memories").replace("WITH ", "WITH RECURSIVE ", 1)
    + WINDOWS_SQL(1000)
    + f""", x AS (SELECT session, win, split_part(string_agg('[' || role || ']: ' || body, chr(10) ORDER BY msg_idx), chr(10), 1) AS content FROM packed WHERE session % 7 <> 0 AND session % 4 <> 0 AND session % 11 >= 7 GROUP BY session, win),
    new AS (SELECT session * 1000 + win AS new_id, session, win, content, '' AS context, '' AS resolution FROM x), {_OLD}, {upload_sql('new', 'old', 'session, win')}
    SELECT session AS segment_id, win AS "window", content, memory_type, action, list_filter(['trajectory', 'type:' || CASE WHEN session % 2 = 0 THEN 'code' ELSE 'other' END, 'segment:' || session,
    CASE WHEN session % 3 <> 0 THEN 'topic:' || substring(repeat('topic ', 8) || session, 1, 40) END, CASE WHEN session % 5 <> 0 THEN 'agent:agent' || (session % 4) END], lambda x: x IS NOT NULL) AS tags FROM up"""
)
def pipe09_extract_and_upload(spark, sf):
    up = Q.extract_and_upload(_sessions(spark, sf), X.native(spark, sf), _split(spark, sf)[1], window=1000, embedder=digits)
    return up.select("segment_id", "window", "content", "memory_type", "action", "tags")


@query(
    ctes("native")
    + """, n AS (SELECT session, count(*) AS n FROM native GROUP BY session), s AS (SELECT session, msg_idx, CASE WHEN n > 2 THEN sum(CASE WHEN role = 'user' AND msg_idx > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY msg_idx) ELSE 0 END AS k, n FROM native JOIN n USING (session))
    SELECT session, CAST(k AS INTEGER) AS segment_index, CAST(min(msg_idx) AS INTEGER) AS start_line, CAST(max(msg_idx) AS INTEGER) AS end_line, CASE WHEN max(n) <= 2 THEN 'full conversation' ELSE 'task' END AS topic FROM s GROUP BY session, k"""
)
def pipe07_task_segments(spark, sf):
    return K.task_segments(X.native(spark, sf), by_user_turns())


def by_user_turns():
    """A segmenter for want of a model: a task begins with each message of the user."""

    def segment(lines: list[str]) -> list[tuple[int, int, str]]:
        begins = [1, *(i for i, line in enumerate(lines, 1) if i > 1 and "] [user]:" in line.split(":", 1)[0] + ":")]
        return [(b, e - 1, "task") for b, e in zip(begins, [*begins[1:], len(lines) + 1], strict=True)]

    return segment


@query(
    ctes("native").replace("WITH ", "WITH RECURSIVE ", 1)
    + WINDOWS_SQL(2000)
    + """, c AS (SELECT session, count(*) AS n FROM native GROUP BY session), g AS (SELECT p.session, p.msg_idx, CASE WHEN n <= 2 THEN 0 ELSE win END AS segment_index FROM packed p JOIN c USING (session)),
    spans AS (SELECT session, segment_index, min(msg_idx) AS start_line, max(msg_idx) AS end_line, count(*) AS lines FROM g GROUP BY session, segment_index)
    SELECT session, segment_index, start_line, end_line FROM spans"""
)
def pipe06_segment_sessions(spark, sf):
    return K.segment_sessions(X.native(spark, sf), 2000).select("session", "segment_index", "start_line", "end_line")


@query(
    ctes("native").replace("WITH ", "WITH RECURSIVE ", 1)
    + WINDOWS_SQL(2000)
    + """, c AS (SELECT session, count(*) AS n FROM native GROUP BY session), g AS (SELECT DISTINCT p.session, CASE WHEN n <= 2 THEN 0 ELSE win END AS i FROM packed p JOIN c USING (session))
    SELECT 'insert' AS what, session, i AS segment_index FROM g WHERE session % 3 <> 2 UNION ALL SELECT 'superseded', session, i FROM g WHERE session % 3 = 0"""
)
def pipe06_superseded_segments(spark, sf):
    found = K.segment_sessions(X.native(spark, sf), 2000)
    # Of three sessions one is known with other fingerprints, one is new, one is known as it is.
    known = found.where("session % 3 <> 1").withColumn("fingerprint", F.when(F.col("session") % 3 == 0, "old").otherwise(F.col("fingerprint")))
    return K.new_and_superseded(known, found)


_PROMPT = f"""placed AS (SELECT cluster_id, memory_id, row_number() OVER (PARTITION BY cluster_id ORDER BY added_at, memory_id) AS i, {cut_sql('content', 200)} AS c, {cut_sql('context', 150)} AS x, {cut_sql('resolution', 200)} AS r FROM members JOIN memories ON memory_id = id),
    prompts AS (SELECT cluster_id, count(*) AS n, string_agg('### Experience ' || i || ' (id: ' || substring(CAST(memory_id AS VARCHAR), 1, 8) || ')' || chr(10) || '- Content: ' || c || CASE WHEN x <> '' THEN chr(10) || '- Context: ' || x ELSE '' END || CASE WHEN r <> '' THEN chr(10) || '- Resolution: ' || r ELSE '' END, chr(10) || chr(10) ORDER BY i) FILTER (WHERE i <= 400) AS prompt,
    list(memory_id ORDER BY i) AS ids FROM placed GROUP BY cluster_id)"""


@query(ctes("members", "memories") + f", {_PROMPT} SELECT cluster_id, CAST(n AS INTEGER) AS n, prompt FROM prompts")
def udf16_memory_prompt(spark, sf):
    return E.prompt(X.members(spark, sf), X.memories(spark, sf), entries=400).select("cluster_id", "n", "prompt")


_GOOD = "when it fails, use this: " + "x" * 450 + "\n1. a\n2. b\n3. c"
_MEMBERS = "mem AS (SELECT CASE WHEN memory_id < 4 THEN 8 ELSE memory_id % 8 END AS cluster_id, memory_id, added_at FROM members)"
_CLUST = "clus AS (SELECT unnest(range(10)) AS cluster_id)"


def _clusters(spark, sf):
    m = X.members(spark, sf).withColumn("cluster_id", F.when(F.col("memory_id") < 4, 8).otherwise(F.col("memory_id") % 8))
    c = spark.range(10).select(F.col("id").alias("cluster_id"), F.when(F.col("id") % 2 == 0, "given").otherwise("").alias("topic"), F.lit("").alias("skill_slug"))
    return c, m


def _synthesize(prompt, topic):
    n = F.length(prompt) % 4
    name = F.concat(F.lit("Skill "), topic)
    text = F.when(n == 1, "short").otherwise(F.lit(_GOOD))
    return F.when(F.col("cluster_id") != 3, F.struct(F.when(n == 0, "insufficient").otherwise("ok").alias("quality"), name.alias("name"), F.lit("d").alias("description"), text.alias("content")))


def _verify(content, prompt):
    grounded = F.when(F.length(prompt) % 3 == 0, 0.5).otherwise(0.9)
    return F.struct(grounded.alias("grounded"), F.lit(False).alias("contradiction"), F.lit(0.8).alias("clarity"), F.lit(None).cast("double").alias("specificity"), F.lit(1.0).alias("preserves"))


_CRYSTAL = (
    ctes("members", "memories")
    + f", {_MEMBERS}, {_PROMPT.replace('FROM members JOIN', 'FROM mem JOIN').replace(' FILTER (WHERE i <= 400)', '')}, {_CLUST}"
    + """, j AS (SELECT cluster_id, coalesce(n, 0) AS n, prompt, ids, CASE WHEN cluster_id % 2 = 0 THEN 'given' ELSE 'made' END AS topic, length(prompt) AS l FROM clus LEFT JOIN prompts USING (cluster_id)),
    o AS (SELECT *, CASE WHEN n < 5 THEN 'too_few' WHEN cluster_id = 3 OR l % 4 = 0 THEN 'insufficient' WHEN l % 4 = 1 THEN 'low_quality' WHEN l % 3 = 0 THEN 'unverified' ELSE 'crystallized' END AS outcome FROM j),
    k AS (SELECT cluster_id, row_number() OVER (PARTITION BY topic ORDER BY cluster_id) AS k FROM o WHERE outcome = 'crystallized'),
    s AS (SELECT o.*, 'skill-' || topic || CASE WHEN topic = 'given' THEN CASE k WHEN 1 THEN '-1' ELSE '-' || (k + 1) END ELSE CASE k WHEN 1 THEN '' ELSE '-' || (k - 1) END END AS slug FROM o LEFT JOIN k USING (cluster_id))"""
)


def _crystallized(spark, sf):
    c, m = _clusters(spark, sf)
    # The names skill-given and skill-given-2 are taken.
    skills = spark.createDataFrame([("skill-given", "1.0.0"), ("skill-given-2", "1.0.0"), ("skill-made", "1.1.0")], "slug string, version string")
    return E.crystallize(c, m, X.memories(spark, sf), skills, synthesize=_synthesize, verify=_verify, topic=lambda p: F.when(F.length(p) >= 0, "made"))


@query(_CRYSTAL + " SELECT cluster_id, outcome, CAST(n AS INTEGER) AS n, CASE WHEN topic = 'made' AND prompt IS NULL THEN '' ELSE topic END AS topic, slug, CASE WHEN outcome = 'crystallized' THEN 0.755::DOUBLE END AS score FROM s")
def pipe14_crystallize(spark, sf):
    return _crystallized(spark, sf).select("cluster_id", "outcome", "n", "topic", "slug", F.round("score", 4).alias("score"))


@query(
    _CRYSTAL
    + """ SELECT slug AS skill_slug, cluster_id, CAST(NULL AS VARCHAR) AS old_version, '1.0.0' AS new_version, 0.755::DOUBLE AS new_score, 'crystallized' AS status, 'run' AS trigger, CAST(n AS INTEGER) AS memory_count, ids AS new_memory_ids, 'Crystallized from ' || n || ' memories' AS mutation_summary FROM s WHERE outcome = 'crystallized'
    UNION ALL SELECT 'old', -1, NULL, '1.0.0', 0.5, 'crystallized', 'first', 5, [1], 'x'"""
)
def dml12_audit_rows(spark, sf):
    new = E.audit_of_new(_crystallized(spark, sf), "run")
    history = spark.createDataFrame([("old", -1, None, "1.0.0", None, 0.5, "crystallized", "first", 5, [1], "x")], new.schema)
    return E.with_audit(history, new).drop("old_score").withColumn("new_score", F.round("new_score", 4))


def _revise(text, version, prompt, n):
    # By cluster: nothing to do, too short, or another text.
    kind = F.col("cluster_id") % 4
    content = F.when(kind == 1, "short").otherwise(F.lit(_GOOD))
    return F.struct(F.when(kind == 0, "unnecessary").otherwise("ok").alias("evolution"), F.lit("").alias("name"), F.lit("new").alias("description"), content.alias("content"))


@query(
    ctes("members", "memories")
    + """, mem AS (SELECT memory_id % 9 AS cluster_id, memory_id, added_at FROM members), n AS (SELECT cluster_id, count(*) AS n, list(memory_id ORDER BY added_at, memory_id) AS ids FROM mem JOIN memories ON memory_id = id GROUP BY cluster_id),
    o AS (SELECT *, CASE cluster_id % 4 WHEN 0 THEN 'unnecessary' WHEN 1 THEN 'low_quality' ELSE CASE WHEN cluster_id = 2 THEN 'revert' ELSE 'recrystallized' END END AS outcome FROM n)
    SELECT cluster_id, outcome, CASE WHEN outcome = 'recrystallized' THEN ids[len(ids) - 1:] END AS ids, CASE WHEN outcome = 'recrystallized' THEN '1.' || (cluster_id + 1) || '.0' END AS new_version,
    CASE WHEN outcome IN ('revert', 'recrystallized') THEN 0.755::DOUBLE END AS score, CASE WHEN outcome = 'recrystallized' THEN 'old name' END AS name, CASE WHEN outcome = 'recrystallized' THEN 'new' END AS description FROM o"""
)
def pipe15_recrystallize(spark, sf):
    m = X.members(spark, sf).withColumn("cluster_id", F.col("memory_id") % 9)
    c = spark.range(9).select(F.col("id").alias("cluster_id"), F.concat(F.lit("s"), "id").alias("skill_slug"))
    skills = c.select(
        F.col("skill_slug").alias("slug"), F.concat(F.lit("1."), "cluster_id", F.lit(".0")).alias("version"), F.lit("old name").alias("name"), F.lit("old").alias("description"), F.lit("t").alias("text"),
        F.when(F.col("cluster_id") == 2, 0.9).otherwise(0.6).alias("structure_score"),
    )
    grown = c.select("cluster_id", F.lit(2).cast("long").alias("n"))
    verify = lambda content, prompt: F.struct(F.lit(0.9).alias("grounded"), F.lit(False).alias("contradiction"), F.lit(0.8).alias("clarity"), F.lit(None).cast("double").alias("specificity"), F.lit(1.0).alias("preserves"))
    r = E.recrystallize(c, m, X.memories(spark, sf), skills, grown, _revise, verify)
    return r.select("cluster_id", "outcome", "ids", "new_version", F.round("score", 4).alias("score"), "name", "description")


# What models do, each with a stand-in that SQL can say.


@query(ctes("memories") + f"SELECT id, CASE WHEN id % 3 = 0 THEN 'life' ELSE CASE WHEN {_any(T.SECURITY_MARKERS, 'b')} THEN 'security' WHEN {_any(T.ERROR_MARKERS, 'b')} THEN 'error' ELSE 'pattern' END END AS memory_type FROM (SELECT *, lower(concat_ws(chr(10), content, context, resolution)) AS b FROM memories)")
def udf02_classified(spark, sf):
    of = lambda content, context, resolution: F.when(F.col("id") % 3 == 0, "life").when(F.col("id") % 3 == 1, "no such type")
    return X.memories(spark, sf).select("id", T.typed(F.col("content"), F.col("context"), F.col("resolution"), of).alias("memory_type"))


@query(ctes("memories") + f"SELECT id, CASE WHEN {_any(T.SECURITY_MARKERS, 'b')} THEN 'security' WHEN {_any(T.ERROR_MARKERS, 'b')} THEN 'error' ELSE 'pattern' END AS memory_type FROM (SELECT *, lower(concat_ws(chr(10), content, context, resolution)) AS b FROM memories)")
def fn57_type_or_rule(spark, sf):
    return X.memories(spark, sf).select("id", T.typed(F.col("content"), F.col("context"), F.col("resolution")).alias("memory_type"))


@query(ctes("memories") + "SELECT id, CASE WHEN id % 2 = 0 THEN resolution || content ELSE content END AS content, context, CASE WHEN id % 2 = 0 THEN 'r' ELSE resolution END AS resolution FROM memories")
def udf04_merged_memories(spark, sf):
    m = X.memories(spark, sf)
    merger = lambda old, new: F.when(F.col("id") % 2 == 0, F.struct(F.concat(new[0], old[0]).alias("content"), F.lit("").alias("context"), F.lit("r").alias("resolution")))
    fields = K.merged_fields([F.col("content"), F.col("context"), F.col("resolution")], [F.col("resolution"), F.lit(""), F.lit("")], merger, cap=0)
    return m.select("id", *[c.alias(n) for n, c in zip(("content", "context", "resolution"), fields, strict=True)])


_L = lambda n: f"CASE WHEN {strip_sql('content')} <> '' THEN {cut_sql(flat_sql('content'), n)} WHEN {strip_sql('context')} <> '' THEN {cut_sql(flat_sql('context'), n)} ELSE {cut_sql(flat_sql('resolution'), n)} END"
_L1 = cut_sql("whole", DEFAULTS.l1_tokens)
_BOTH = f"concat_ws(chr(10), CASE WHEN content <> '' THEN {cut_sql('flat', int(DEFAULTS.l1_tokens * 0.7))} END, CASE WHEN context <> '' THEN {cut_sql('context', int(DEFAULTS.l1_tokens * 0.15))} END, CASE WHEN resolution <> '' THEN {cut_sql('resolution', int(DEFAULTS.l1_tokens * 0.15))} END)"
_SUM = f", s AS (SELECT id, {_L(DEFAULTS.l0_tokens)} AS l0, {_BOTH} AS whole FROM (SELECT *, {flat_sql('content')} AS flat FROM memories))"


@query(ctes("memories") + _SUM + f" SELECT id, l0 AS summary_l0, {_L1} AS overview_l1 FROM s")
def fn16_summaries(spark, sf):
    l0, l1 = T.summaries(F.col("content"), F.col("context"), F.col("resolution"), DEFAULTS.l0_tokens, DEFAULTS.l1_tokens)
    return X.memories(spark, sf).select("id", l0.alias("summary_l0"), l1.alias("overview_l1"))


@query(ctes("memories") + _SUM + f" SELECT id, CASE WHEN id % 2 = 0 THEN 'short' ELSE l0 END AS summary_l0, CASE WHEN id % 2 = 0 THEN 'long' ELSE {_L1} END AS overview_l1 FROM s")
def udf05_summaries(spark, sf):
    own = lambda content, context, resolution: F.struct(F.when(F.col("id") % 2 == 0, "short").alias("l0"), F.lit("long").alias("l1"))
    l0, l1 = T.summaries_or_rule(F.col("content"), F.col("context"), F.col("resolution"), DEFAULTS.l0_tokens, DEFAULTS.l1_tokens, own)
    return X.memories(spark, sf).select("id", l0.alias("summary_l0"), l1.alias("overview_l1"))


@query(ctes("memories") + _SUM + f" SELECT id, l0 AS summary_l0, {_L1} AS overview_l1 FROM s")
def fn56_summaries_or_rule(spark, sf):
    l0, l1 = T.summaries_or_rule(F.col("content"), F.col("context"), F.col("resolution"), DEFAULTS.l0_tokens, DEFAULTS.l1_tokens)
    return X.memories(spark, sf).select("id", l0.alias("summary_l0"), l1.alias("overview_l1"))


@query(f"SELECT doc_id, i AS pos, line AS content FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE {strip_sql('line')} <> ''")
def udf06_extracted_memories(spark, sf):
    none = F.lit("")
    each = lambda text: F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("content"), none.alias("context"), none.alias("resolution"), F.array().cast("array<string>").alias("tags")))
    d = X.table(spark, sf, "documents")
    return Q.extracted(d, ["doc_id"], F.array().cast("array<string>"), each).select("doc_id", F.col("pos").cast("long").alias("pos"), "content")


def _said_by_user(texts):
    """One memory a user line of the window, which tells how many lines came before it."""
    return [{"content": t, "context": f"{n} before", "tags": ["window"]} for n, t in enumerate(texts) if t.startswith("user")]


_ASKS = "SELECT CAST(conv_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role || text AS content, n || ' before' AS context, ['window'] AS tags FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) WHERE role = 'user'"


@query(_ASKS)
def udf06_extracted_windows(spark, sf):
    """An extractor that sees whole sessions, as a table function over partitions in order."""
    c = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), F.concat("role", "text").alias("text"))
    return Q.extracted_by_table(c, Q.table_extractor(_said_by_user)).select("key", "pos", "content", "context", "tags")


@query(_ASKS)
def udf06_extracted_by_sql(spark, sf):
    """The same, registered under a name and called from SQL."""
    spark.udtf.register("extract_memories", Q.table_extractor(_said_by_user))
    c = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), F.concat("role", "text").alias("text"))
    return spark.sql("SELECT key, pos, content, context, tags FROM extract_memories(TABLE({c}) PARTITION BY key ORDER BY place)", c=c)


@query(ctes("native") + "SELECT session, CAST(CASE WHEN count(*) <= 2 THEN count(*) END AS INTEGER) AS end_line FROM native GROUP BY session")
def udf07_segments_without_model(spark, sf):
    m = X.native(spark, sf)
    return m.select("session").distinct().join(K.task_segments(m).select("session", "end_line"), "session", "left")


_SUMMARIES = """told AS (SELECT cluster_id, string_agg('- ' || substring(content, 1, 100), chr(10) ORDER BY i) AS said FROM (SELECT cluster_id, content, row_number() OVER (PARTITION BY cluster_id ORDER BY added_at, memory_id) AS i
    FROM members JOIN memories ON memory_id = id) WHERE i <= 10 AND content <> '' GROUP BY cluster_id)"""


@query(ctes("members", "memories") + f", {_SUMMARIES} SELECT cluster_id, said AS summaries FROM told")
def udf11_topic_summaries(spark, sf):
    return E.summaries(X.members(spark, sf), X.memories(spark, sf))


@query(ctes("members", "memories") + f", {_SUMMARIES} SELECT cluster_id, substring('On ' || (length(said) - length(replace(said, chr(10), '')) + 1) || ' memories: ' || replace(said, chr(10), ' '), 1, 80) AS topic FROM told")
def udf11_cluster_topics(spark, sf):
    c = X.members(spark, sf).select("cluster_id").distinct().select("cluster_id", F.lit("").alias("topic"), F.lit("").alias("skill_slug"))
    none = X.skills(spark, sf).select("slug", "version")
    said = lambda t: F.concat(F.lit(" \"'On "), F.size(F.split(t, "\n")), F.lit(" memories: "), F.replace(t, F.lit("\n"), F.lit(" ")))
    return E.crystallize(c, X.members(spark, sf), X.memories(spark, sf), none, topic=said).select("cluster_id", "topic")


_CYCLE = (
    ctes("clusters", "members", "evolutions")
    + """, e AS (SELECT cluster_id, max(timestamp) AS last FROM evolutions WHERE status IN ('crystallized', 'recrystallized') GROUP BY cluster_id), n AS (SELECT m.cluster_id, count(*) AS n, count(*) FILTER (WHERE last IS NULL OR added_at > last) AS since FROM members m LEFT JOIN e USING (cluster_id) GROUP BY m.cluster_id),
    one AS (SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN 'insufficient' ELSE 'crystallized' END AS outcome FROM (SELECT cluster_id FROM clusters JOIN n USING (cluster_id) WHERE skill_slug = '' AND n >= 5 ORDER BY created_at DESC, cluster_id LIMIT 4)),
    left_over AS (SELECT 4 - count(*) FILTER (WHERE outcome = 'crystallized') AS k FROM one),
    two AS (SELECT cluster_id FROM (SELECT cluster_id, row_number() OVER (ORDER BY created_at DESC, cluster_id) AS r FROM clusters JOIN n USING (cluster_id) WHERE skill_slug <> '' AND since >= 3), left_over WHERE r <= k)
    SELECT cluster_id, 1 AS phase, outcome FROM one UNION ALL SELECT cluster_id, 2, 'revert' FROM two"""
)


@query(_CYCLE)
def pipe13_evolution_cycle(spark, sf):
    """Only skills that were made use up the limit: clusters of every third number have nothing to say."""
    s = X.clusters(spark, sf).where("skill_slug <> ''").select(F.col("skill_slug").alias("slug"), F.lit("1.0.0").alias("version"), F.lit("n").alias("name"), F.lit("d").alias("description"), F.lit("t").alias("text"), F.lit(0.9).alias("structure_score"))
    new = lambda prompt, topic: F.when(F.col("cluster_id") % 3 != 0, F.struct(F.lit("ok").alias("quality"), topic.alias("name"), F.lit("d").alias("description"), F.lit(_GOOD).alias("content")))
    revise = lambda text, version, prompt, n: F.struct(F.lit("ok").alias("evolution"), F.lit("").alias("name"), F.lit("").alias("description"), F.lit(_GOOD).alias("content"))
    one, two = E.cycle(X.clusters(spark, sf), X.members(spark, sf), X.memories(spark, sf), s, X.evolutions(spark, sf), 4, new, revise)
    return one.select("cluster_id", F.lit(1).alias("phase"), "outcome").unionByName(two.select("cluster_id", F.lit(2).alias("phase"), "outcome"))


@query(ctes("members", "memories") + f", {_PROMPT} SELECT cluster_id, CASE WHEN n < 5 THEN 'too_few' ELSE 'insufficient' END AS outcome FROM prompts")
def udf08_without_synthesizer(spark, sf):
    c = X.members(spark, sf).select("cluster_id").distinct().select("cluster_id", F.lit("t").alias("topic"), F.lit("").alias("skill_slug"))
    return E.crystallize(c, X.members(spark, sf), X.memories(spark, sf), X.skills(spark, sf).select("slug", "version")).select("cluster_id", "outcome")


def _skills_of_clusters(spark, sf):
    c = X.members(spark, sf).select("cluster_id").distinct().select("cluster_id", F.concat(F.lit("s"), "cluster_id").alias("skill_slug"))
    s = c.select(F.col("skill_slug").alias("slug"), F.lit("1.0.0").alias("version"), F.lit("n").alias("name"), F.lit("d").alias("description"), F.lit("t").alias("text"), F.lit(0.5).alias("structure_score"))
    return c, s, c.select("cluster_id", F.lit(3).cast("long").alias("n"))


@query(ctes("members", "memories") + ", n AS (SELECT DISTINCT cluster_id FROM members JOIN memories ON memory_id = id) SELECT cluster_id, 'unnecessary' AS outcome FROM n")
def udf09_without_reviser(spark, sf):
    c, s, grown = _skills_of_clusters(spark, sf)
    return E.recrystallize(c, X.members(spark, sf), X.memories(spark, sf), s, grown).select("cluster_id", "outcome")


@query(ctes("members", "memories") + ", n AS (SELECT DISTINCT cluster_id FROM members JOIN memories ON memory_id = id) SELECT cluster_id, CASE cluster_id % 3 WHEN 0 THEN 'constraint_failed' WHEN 1 THEN 'constraint_failed' ELSE 'revert' END AS status, CASE WHEN cluster_id % 3 = 2 THEN 'Upgrade gate: 0.50 <= 0.50' ELSE 'Failed faithfulness verification' END AS mutation_summary FROM n")
def udf10_verified_revisions(spark, sf):
    c, s, grown = _skills_of_clusters(spark, sf)
    revise = lambda text, version, prompt, n: F.struct(F.lit("ok").alias("evolution"), F.lit("").alias("name"), F.lit("").alias("description"), F.lit(_GOOD).alias("content"))
    kind = F.col("cluster_id") % 3
    # Not grounded, contradicted, or not checked at all.
    verify = lambda content, prompt: F.when(kind < 2, F.struct(F.when(kind == 0, 0.1).otherwise(0.9).alias("grounded"), (kind == 1).alias("contradiction"), F.lit(1.0).alias("clarity"), F.lit(1.0).alias("specificity"), F.lit(1.0).alias("preserves")))
    r = E.recrystallize(c, X.members(spark, sf), X.memories(spark, sf), s, grown, revise, verify)
    return E.audit_of_revised(r).select("cluster_id", "status", "mutation_summary")


@query("SELECT doc_id, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS tokens, greatest(200000 - 8192 - len(regexp_extract_all(text, '\\w+|[^\\w\\s]')), 256) AS budget FROM documents")
def udf14_token_count(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"), K.text_budget(F.col("text")).cast("long").alias("budget"))


@query("SELECT doc_id, greatest(300 - CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS BIGINT), 256) AS budget FROM documents")
def fn40_text_budget(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", K.text_budget(F.col("text"), 400, 100).cast("long").alias("budget"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE least(1.0, greatest(0.0, l_discount * 30 - 0.5)) END AS x FROM lineitem")
def fn39_unit_interval(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", K.unit_interval(F.when(F.col("l_linenumber") != 1, F.col("l_discount") * 30 - 0.5)).alias("x"))


@query(f"SELECT doc_id, {cut_sql('text', 300)} AS capped, text AS uncapped FROM documents")
def fn59_capped_field(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.capped(F.col("text"), 300).alias("capped"), T.capped(F.col("text"), 0).alias("uncapped"))


@query("SELECT user_id AS id, CAST(sum(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END) AS BIGINT) AS hits FROM events GROUP BY user_id")
def pipe16_maintenance(spark, sf):
    """The maintenance loop once over a stream of hits: one step adds them up, another fails and hinders nothing."""
    from sparkloom.scratch import new_path

    out, schema = new_path(spark, "hits"), X.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")

    def add(batch, batch_id):
        batch.groupBy("id").agg(F.sum("weight").alias("hits")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def fails(batch, batch_id):
        raise ValueError("a step that fails")

    told: list[str] = []
    q = maintenance.maintain(X.hits_of(events), {"fails": fails, "add": add}, new_path(spark, "checkpoint"), seen=lambda _, r: told.append(r["add"]))
    q.awaitTermination()
    if set(told) != {"ok"}:
        raise RuntimeError(f"maintenance: {told}")
    return spark.read.parquet(out).groupBy("id").agg(F.sum("hits").alias("hits"))


@query(
    ctes("memories")
    + "SELECT id, CASE WHEN id % 10 IN (2, 4) AND status <> 'archived' THEN 'archived' ELSE status END AS status FROM memories"
)
def jon12_archived_segments(spark, sf):
    m = X.memories(spark, sf).select("id", "status", F.array(F.lit("trajectory"), F.concat(F.lit("segment:s"), F.col("id") % 10)).alias("tags"))
    gone = spark.createDataFrame([("s2",), ("s4",), ("s4",)], "id string")
    return Q.memories_of_segments(m, gone).select("id", "status")
