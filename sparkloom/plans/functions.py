"""Scalar, array, JSON and text functions over tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS
from sparkloom.functions import quality
from sparkloom.functions import text as T
from sparkloom.functions import vectors as V
from sparkloom.functions import messages as M
from sparkloom.functions import sections as S
from sparkloom.plans.registry import cut_sql, query, strip_sql
from sparkloom.sources import fixtures as X
from sparkloom.sources.fixtures import AS_OF, ctes


@query(ctes("vectors") + "SELECT a.id, round(coalesce(list_cosine_similarity(a.embedding, b.embedding), 0), 4) AS sim FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def fn01_cosine(spark, sf):
    v = X.vectors(spark, sf)
    other = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return v.join(other, "id").select("id", F.round(V.cosine(F.col("embedding"), F.col("other")), 4).alias("sim"))


@query(ctes("memories") + f"SELECT id, round(exp(-0.05 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_hit_at), 0) / 86400e6), 4) AS hot FROM memories")
def fn02_hotness(spark, sf):
    return X.memories(spark, sf).select("id", F.round(V.hotness(F.col("last_hit_at"), F.lit(AS_OF).cast("timestamp_ntz"), DEFAULTS.decay_alpha), 4).alias("hot"))


@query(ctes("memories") + "SELECT id, CASE tier WHEN 'hot' THEN 1.2 WHEN 'warm' THEN 1.0 WHEN 'cold' THEN 0.8 ELSE 1.0 END::DOUBLE AS boost FROM memories")
def fn03_tier_boost(spark, sf):
    return X.memories(spark, sf).select("id", V.boost(F.col("tier"), DEFAULTS.tier_boost).alias("boost"))


# A text for every event that holds what the patterns look for.
_NOTE = """'user ' || user_id || ' ' || CASE event_type WHEN 'error' THEN 'Traceback: ValueError in job' WHEN 'click' THEN 'SQL Injection seen' WHEN 'view' THEN 'token=ab' || event_id || '.c' WHEN 'signup'
    THEN 'mail at /home/bob/x and C:\\Users\\Ann\\y, call 13' || lpad(CAST(event_id AS VARCHAR), 9, '0') ELSE 'Bearer abc.DEF-' || event_id END || ' AKIA' || lpad(CAST(event_id AS VARCHAR), 16, 'A')"""


def _notes(spark, sf):
    e = X.table(spark, sf, "events")
    i = F.col("event_id").cast("string")
    middle = (
        F.when(F.col("event_type") == "error", F.lit("Traceback: ValueError in job"))
        .when(F.col("event_type") == "click", F.lit("SQL Injection seen"))
        .when(F.col("event_type") == "view", F.concat(F.lit("token=ab"), i, F.lit(".c")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("mail at /home/bob/x and C:\\Users\\Ann\\y, call 13"), F.lpad(i, 9, "0")))
        .otherwise(F.concat(F.lit("Bearer abc.DEF-"), i))
    )
    return e.select("event_id", "event_type", F.concat(F.lit("user "), F.col("user_id"), F.lit(" "), middle, F.lit(" AKIA"), F.lpad(i, 16, "A")).alias("note"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chain(patterns: list[tuple[str, str]], text: str) -> str:
    for p, r in patterns:
        text = f"regexp_replace({text}, {_quoted(p)}, {_quoted(r)}, 'gi')"
    return text


def _any(words: list[str], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(w)})" for w in words) + ")"


@query(
    f"WITH n AS (SELECT event_id, lower({_NOTE}) AS b FROM events) SELECT event_id, CASE WHEN {_any(T.SECURITY_MARKERS, 'b')} THEN 'security' WHEN {_any(T.ERROR_MARKERS, 'b')} THEN 'error' ELSE 'pattern' END AS memory_type FROM n"
)
def fn04_memory_type(spark, sf):
    return _notes(spark, sf).select("event_id", T.memory_type(F.col("note"), F.lit(None).cast("string"), F.lit("")).alias("memory_type"))


@query(f"SELECT event_id, {_chain(T.PATH_PATTERNS + T.CREDENTIAL_PATTERNS, _NOTE)} AS clean FROM events")
def fn05_regex_sanitize(spark, sf):
    return _notes(spark, sf).select("event_id", T.replace_all(F.col("note"), T.PATH_PATTERNS + T.CREDENTIAL_PATTERNS).alias("clean"))


@query(f"SELECT event_id, {_chain(T.PATH_PATTERNS, _NOTE)} AS clean FROM events")
def fn06_path_patterns(spark, sf):
    return _notes(spark, sf).select("event_id", T.replace_all(F.col("note"), T.PATH_PATTERNS).alias("clean"))


@query(f"SELECT event_id, {_chain(T.CREDENTIAL_PATTERNS, _NOTE)} AS clean FROM events")
def fn07_credential_patterns(spark, sf):
    return _notes(spark, sf).select("event_id", T.replace_all(F.col("note"), T.CREDENTIAL_PATTERNS).alias("clean"))


@query(
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN repeat('漏', CAST(event_id % 9 AS INTEGER)) || 'abcdefgh' ELSE event_type END AS t FROM events) SELECT event_id, CASE WHEN len(regexp_extract_all(t, '[\u4e00-\u9fff]')) / greatest(length(t), 1) > 0.2 THEN 'zh' ELSE 'en' END AS lang FROM t"
)
def fn08_language(spark, sf):
    e = X.table(spark, sf, "events")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.repeat(F.lit("漏"), (F.col("event_id") % 9).cast("int")), F.lit("abcdefgh"))).otherwise(F.col("event_type"))
    return e.select("event_id", T.language(t).alias("lang"))


@query("SELECT event_id, 'mail <EMAIL_ADDRESS> from <IP_ADDRESS>, card ' || CASE WHEN event_id % 2 = 0 THEN '<CREDIT_CARD>' ELSE '4111-1111-1111-1112' END AS clean FROM events")
def fn09_personal_data(spark, sf):
    e = X.table(spark, sf, "events")
    card = F.when(F.col("event_id") % 2 == 0, "4111 1111 1111 1111").otherwise("4111-1111-1111-1112")
    note = F.concat(F.lit("mail a"), "event_id", F.lit("@ex.org from 10.0."), F.col("event_id") % 250, F.lit(".7, card "), card)
    return e.select("event_id", T.without_personal_data(note).alias("clean"))


@query(f"SELECT event_id, {_chain(T.PATH_PATTERNS + T.CREDENTIAL_PATTERNS + T.PII_PATTERNS, _NOTE)} AS clean FROM events")
def fn10_sanitize(spark, sf):
    return _notes(spark, sf).select("event_id", T.sanitize(F.col("note")).alias("clean"))


@query(f"SELECT doc_id, {cut_sql('text', 500)} AS cut, {cut_sql('text', 'doc_id % 90')} AS short FROM documents")
def fn11_truncate(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", T.truncate(F.col("text"), 500).alias("cut"), T.truncate(F.col("text"), (F.col("doc_id") % 90).cast("int")).alias("short"))


@query(
    """WITH p AS (SELECT doc_id, text, least(length(text), 20 + doc_id % 300) AS pos FROM documents), t AS (SELECT *, CAST(floor(pos * 0.8::DOUBLE) AS BIGINT) AS keep FROM p),
    e AS (SELECT *, length(regexp_extract(substring(text, keep + 1, pos - keep), '(?s)^(.*[。！？；\n.!?;])', 1)) AS n FROM t) SELECT doc_id, CASE WHEN n > 0 THEN keep + n ELSE pos END AS pos FROM e"""
)
def fn12_sentence_end(spark, sf):
    d = X.table(spark, sf, "documents")
    pos = F.least(F.length("text"), (F.col("doc_id") % 300 + 20).cast("int"))
    return d.select("doc_id", T.sentence_end(F.col("text"), pos).cast("long").alias("pos"))


@query(ctes("native") + "SELECT session, msg_idx, body FROM shown")
def fn15_message_body(spark, sf):
    return X.native(spark, sf).select("session", "msg_idx", "body")


@query(ctes("native") + "SELECT session, msg_idx, role, body FROM shown WHERE body IS NOT NULL")
def fn49_plain_messages(spark, sf):
    return X.native(spark, sf).where("body IS NOT NULL").select("session", "msg_idx", "role", "body")


@query(ctes("native") + "SELECT session, string_agg('[' || role || ']: ' || body, chr(10) ORDER BY msg_idx) AS text FROM shown WHERE body <> '' GROUP BY session")
def fn51_joined_messages(spark, sf):
    return M.joined(X.native(spark, sf), ["session"])


@query(
    ctes("native")
    + ", n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY msg_idx) AS i FROM shown WHERE body IS NOT NULL) SELECT session, string_agg('[' || i || '] [' || role || ']: ' || body, chr(10) ORDER BY i) AS text FROM n GROUP BY session"
)
def fn52_numbered_messages(spark, sf):
    return M.numbered(X.native(spark, sf), ["session"])


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def fn17_collapse(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("flat"))


_FLAT = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT doc_id, {strip_sql('text')} AS a, {strip_sql("CASE doc_id % 3 WHEN 0 THEN substring(text, length(text) // 2) WHEN 1 THEN source || doc_id ELSE 'x ' || text END")} AS b FROM documents),
    f AS (SELECT *, {_FLAT.format(x='a')} AS fa, {_FLAT.format(x='b')} AS fb FROM t),
    k AS (SELECT *, CASE WHEN a = '' THEN b WHEN contains(fa, fb) OR contains(a, b) THEN a WHEN contains(fb, fa) OR contains(b, a) THEN b WHEN length(a) + length(b) > 1600 THEN CASE WHEN length(a) >= length(b) THEN a ELSE b END
    ELSE a || chr(10) || chr(10) || '---' || chr(10) || chr(10) || b END AS x FROM f) SELECT doc_id, CASE WHEN b = '' THEN a ELSE {cut_sql('x', 2000)} END AS merged FROM k"""
)
def fn18_merge_fields(spark, sf):
    d, n = X.table(spark, sf, "documents"), F.col("doc_id") % 3
    new = F.when(n == 0, F.substring("text", F.floor(F.length("text") / 2).cast("int"), F.length("text"))).when(n == 1, F.concat("source", "doc_id")).otherwise(F.concat(F.lit("x "), "text"))
    return d.select("doc_id", T.merge_texts(F.col("text"), new, 2000).alias("merged"))


@query(ctes("memories") + "SELECT id, 'memory type: ' || memory_type || ' content: ' || substring(content, 1, 300) || ' context: ' || context || ' resolution: ' || resolution AS input FROM memories")
def fn19_embed_input(spark, sf):
    return X.memories(spark, sf).select("id", T.embed_input(F.col("memory_type"), F.col("content"), F.col("context"), F.col("resolution")).alias("input"))


@query(ctes("segments") + "SELECT id, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN 1.0 WHEN id % 10 = 2 THEN 0.0 ELSE round(score, 4) END AS score FROM segments")
def fn20_score_norm(spark, sf):
    s = X.segments(spark, sf)
    bad = (
        F.when(F.col("id") % 10 == 0, F.lit("{bad"))
        .when(F.col("id") % 10 == 1, F.lit('{"summary":{"overall_score":7}}'))
        .when(F.col("id") % 10 == 2, F.lit('{"summary":{"overall_score":-3}}'))
        .otherwise(F.col("quality_metrics"))
    )
    return s.select("id", F.round(quality.score(bad), 4).alias("score"))


@query(ctes("segments") + "SELECT id, CASE WHEN id % 9 = 0 THEN 'other' ELSE task_type END AS task_type FROM segments")
def fn21_task_type(spark, sf):
    m = F.when(F.col("id") % 9 == 0, F.lit('{"summary":{}}')).otherwise(F.col("quality_metrics"))
    return X.segments(spark, sf).select("id", quality.task_type(m).alias("task_type"))


@query(ctes("segments") + "SELECT id, CASE WHEN id % 8 = 0 THEN NULL ELSE round(score, 4) END AS score FROM segments")
def fn54_assessment_score(spark, sf):
    m = F.when(F.col("id") % 8 == 0, F.lit('{"summary":{"overall_score":"high"}}')).otherwise(F.col("quality_metrics"))
    return X.segments(spark, sf).select("id", F.round(quality.score(m), 4).alias("score"))


_WORDS = {"travel": ["the", "thor"], "food": ["ing", "le "], "home": ["haus", "der "], "law": ["que"]}


@query(
    "WITH k AS (SELECT * FROM (VALUES (0,'travel','the'),(0,'travel','thor'),(1,'food','ing'),(1,'food','le '),(2,'home','haus'),(2,'home','der '),(3,'law','que')) v(o, cat, w)), h AS (SELECT doc_id, cat, o, count(*) AS n FROM documents JOIN k ON contains(lower(text), w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM h) SELECT d.doc_id, coalesce(list(cat ORDER BY r) FILTER (WHERE r <= 3), ['general']) AS categories FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id"
)
def fn22_keyword_categories(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.keyword_categories(F.col("text"), _WORDS).alias("categories"))


_STEPS = "E'\\n1. go\\n2) do\\n- end '"


@query(
    f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || {_STEPS} ELSE text END AS t FROM documents), c AS (SELECT doc_id, floor(length(t) / 3) >= 150 AS long, (len(regexp_extract_all(t, '(?:^|\\n)\\s*(?:\\d+[.)]\\s|[-*]\\s)')) >= 3)::INT + {_any(T.TRIGGER_WORDS, 'lower(t)')}::INT + {_any(T.EDGE_WORDS, 'lower(t)')}::INT AS n FROM t) SELECT doc_id, long AND n >= 2 AS ok FROM c"
)
def fn23_quality_bar(spark, sf):
    d = X.table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n1. go\n2) do\n- end "))).otherwise(F.col("text"))
    return d.select("doc_id", T.quality_bar(t).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 1 THEN 0.5 ELSE 0.35 * coalesce(CASE WHEN l_linenumber <> 2 THEN l_discount END, 0.5) + 0.35 * l_tax + 0.30 * 1.0 END, 4) AS score FROM lineitem")
def fn24_structure_score(spark, sf):
    li = X.table(spark, sf, "lineitem")
    s = T.structure_score(F.when(F.col("l_linenumber") != 2, F.col("l_discount")), F.col("l_tax"), F.lit(None).cast("double"), F.col("l_linenumber") != 1)
    return li.select("l_orderkey", "l_linenumber", F.round(s, 4).alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN true ELSE coalesce(CASE WHEN l_linenumber <> 2 THEN l_discount * 10 END, 0) >= 0.8 AND l_returnflag <> 'R' END AS passed FROM lineitem")
def fn25_verification(spark, sf):
    li = X.table(spark, sf, "lineitem")
    p = T.verification_passed(F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 10), F.col("l_returnflag") == "R", F.col("l_linenumber") != 1)
    return li.select("l_orderkey", "l_linenumber", p.alias("passed"))


@query("SELECT p_partkey, substring(trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9\u4e00-\u9fff]+', '-', 'g'), '-'), 1, 50) AS slug FROM part")
def fn26_slug(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(' ' || p_name || ' __ ' || p_type || ' !'), '[\\s_-]+', '-', 'g'), '[^a-z0-9\u4e00-\u9fff-]', '', 'g'), '-'), ''), 'unknown') AS slug FROM part")
def fn61_slug_variant(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", T.slug_or_unknown(F.concat(F.lit(" "), "p_name", F.lit(" __ "), "p_type", F.lit(" !"))).alias("slug"))


_VER = "CASE p_partkey % 4 WHEN 0 THEN '1.' || p_size || '.7' WHEN 1 THEN '2.' || p_size WHEN 2 THEN 'v' ELSE '1.x.3' END"


def _versions(spark, sf):
    p, n = X.table(spark, sf, "part"), F.col("p_partkey") % 4
    v = F.when(n == 0, F.concat(F.lit("1."), F.col("p_size"), F.lit(".7"))).when(n == 1, F.concat(F.lit("2."), F.col("p_size"))).when(n == 2, F.lit("v")).otherwise(F.lit("1.x.3"))
    return p.select("p_partkey", v.alias("version"))


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.' || (p_size + 1) || '.7' WHEN 1 THEN '2.' || (p_size + 1) ELSE '1.1.0' END AS version FROM (SELECT *, {_VER} AS v FROM part)")
def fn27_bump_minor(spark, sf):
    return _versions(spark, sf).select("p_partkey", T.bump_minor(F.col("version")).alias("version"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.' || p_size || '.8' WHEN 1 THEN '2.' || (p_size + 1) WHEN 2 THEN '1.0.1' ELSE '1.x.4' END AS version FROM part")
def fn28_bump_last(spark, sf):
    return _versions(spark, sf).select("p_partkey", T.bump_last(F.col("version")).alias("version"))


_MD = "'intro ' || doc_id || chr(10) || '## A' || chr(10) || text || chr(10) || chr(10) || '## B ' || lang || chr(10) || 'x' || chr(10) || 'y'"


def _markdown(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("intro "), F.col("doc_id"), F.lit("\n## A\n"), "text", F.lit("\n\n## B "), "lang", F.lit("\nx\ny")).alias("md"))


@query(
    f"""WITH p AS (SELECT doc_id, string_split(regexp_replace({_MD}, '(?m)^## ', chr(1) || '## ', 'g'), chr(1)) AS parts FROM documents),
    e AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS pos, len(parts) AS n FROM p), c AS (SELECT doc_id, pos, CASE WHEN pos < n - 1 THEN regexp_replace(part, '\n$', '') ELSE part END AS part FROM e)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(part, '## ') THEN split_part(part, chr(10), 1) ELSE '' END AS title,
    CASE WHEN NOT starts_with(part, '## ') THEN part WHEN contains(part, chr(10)) THEN substring(part, length(split_part(part, chr(10), 1)) + 2) ELSE '' END AS body FROM c"""
)
def fn34_sections(spark, sf):
    return S.exploded(_markdown(spark, sf), "md", ["doc_id"]).select("doc_id", "pos", "title", "body")


@query(f"SELECT doc_id, {_MD} AS content FROM documents")
def fn65_sections_to_content(spark, sf):
    return _markdown(spark, sf).select("doc_id", S.content(S.parsed(F.col("md"))).alias("content"))


_PATHS = {("a", "SOUL.md"): {"b": "memories/USER.md"}, ("a", "IDENTITY.md"): {"b": None}}


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'SOUL.md' ELSE CASE doc_id % 3 WHEN 0 THEN 'memories/USER.md' WHEN 1 THEN NULL ELSE 'skills/x.md' END END AS target FROM documents")
def fn35_target_path(spark, sf):
    d = X.table(spark, sf, "documents")
    path = F.when((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 3 == 0), F.lit("SOUL.md")).when(F.col("doc_id") % 3 == 1, F.lit("IDENTITY.md")).otherwise(F.lit("skills/x.md"))
    to = F.when(F.col("doc_id") % 5 == 0, F.lit("a")).otherwise(F.lit("b"))
    return d.select("doc_id", S.target_path(F.lit("a"), path, to, _PATHS).alias("target"))


@query(ctes("vectors") + "SELECT id, round(embedding[1], 4) AS first FROM vectors")
def fn41_rounded(spark, sf):
    return X.vectors(spark, sf).select("id", F.round(F.element_at("embedding", 1), 4).alias("first"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS stop_reason FROM events")
def fn48_stop_reason(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return X.table(spark, sf, "events").select("event_id", M.stop_reason(raw).alias("stop_reason"))


@query("SELECT doc_id, lang || ' ' || source || ' ' || substring(text, 1, 500) AS input FROM documents")
def fn53_embed_skill_input(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.embed_skill_input(F.col("lang"), F.col("source"), F.col("text")).alias("input"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE {cut_sql('text', 400)} END AS merged FROM documents")
def fn58_merged_or_old(spark, sf):
    new = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit(""))
    return X.table(spark, sf, "documents").select("doc_id", T.merged_or_old(new, F.col("text"), 400).alias("merged"))


@query("SELECT doc_id, [lang, '  ' || source] AS tasks FROM documents")
def fn66_task_lines(spark, sf):
    body = F.concat("lang", F.lit("\n\n<!-- c -->\n  "), "source", F.lit("\nend -->"))
    return X.table(spark, sf, "documents").select("doc_id", S.task_lines(body).alias("tasks"))
