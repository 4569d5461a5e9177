"""Skill packages, presets, showcases and workspaces: trees of small text files as (path, text), and rows out."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.jsontext import dumped, members, object_or_empty, quoted, string_map

FILE_CAP = 1 << 20


def glob_pattern(pattern: str) -> str:
    """A file pattern as a regular expression: * is any run of characters, also over folders, ? one character."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def allowed(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path has no hidden part and fits one of the patterns."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | path.rlike(glob_pattern(p))
    return fits & ~path.rlike(r"(^|/)\.")


def read_tree(spark: SparkSession, root: str, allow: list[str] | None = None, cap: int = FILE_CAP) -> DataFrame:
    """(path, size, text) of the files below root, paths relative; hidden ones, larger ones, those that are no UTF-8
    and those that no pattern allows are left out. Spark's readers also pass over names that begin with an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    base = re.sub(scheme, "", root).rstrip("/")
    rel = F.substring(F.regexp_replace("path", scheme, ""), F.lit(len(base) + 2), F.length("path"))
    out = files.where(F.col("length") <= cap).select(rel.alias("path"), F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return out.where(allowed(F.col("path"), allow or ["*"]) & F.col("text").isNotNull())


def as_map(tree: DataFrame, key: list[str] = ()) -> DataFrame:
    """(key, resources): the texts of a tree's files by path, for each key."""
    return tree.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "text")))).alias("resources"))


def defaults(tree: DataFrame, product: str) -> DataFrame:
    """(path, text) of the default files of a product, which are those below its folder."""
    inside = F.startswith("path", F.lit(product + "/"))
    return tree.where(inside).select(F.substring("path", F.lit(len(product) + 2), F.length("path")).alias("path"), "text")


def _last_of_each(entries: Column) -> Column:
    """map of array<struct<key, value>>; of equal keys the last counts."""

    def mapped(e: Column) -> Column:
        names = F.transform(e, lambda x: x["key"])
        last = lambda ns: F.filter(e, lambda x, i: ~F.array_contains(F.slice(ns, i + 2, F.size(ns)), x["key"]))
        return F.map_from_entries(T.let(names, last))

    return T.let(entries, mapped)


_FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"


def front_matter(text: Column) -> Column:
    """map<string, string> of a skill file's front matter, null without any.

    A key stands at a line's beginning before the first colon; lines that are indented or have no colon go on with
    the value before them.
    """
    pattern, white = _FRONT, T.WHITE

    @F.arrow_udf("map<string,string>")
    def run(column: pa.Array) -> pa.Array:
        front = re.compile(pattern, re.ASCII)
        out = []
        for text in column.to_pylist():
            found = front.match(text) if text is not None else None
            entries: dict[str, str] = {}
            for part in re.split(r"\n(?=(?![ \t])[^\n]*:)", found[1].strip(white)) if found else []:
                key, colon, value = part.partition(":")
                if colon and "\n" not in key and key[:1] not in (" ", "\t") and key.strip(white):
                    # Of equal keys the last counts, at its own place.
                    entries.pop(key.strip(white), None)
                    entries[key.strip(white)] = re.sub(r"\A([^\n]*?)[ \t\r]+\n", r"\1\n", value).strip(white)
            out.append(list(entries.items()) if found else None)
        return pa.array(out, pa.map_(pa.string(), pa.string()))

    return run(text)


def body(text: Column) -> Column:
    """What stands after a skill file's front matter, trimmed; the whole text without any."""
    return F.when(text.rlike(_FRONT), T.strip(F.regexp_replace(text, _FRONT, ""))).otherwise(text)


def typed_value(value: Column) -> Column:
    """struct<kind, value> of a front matter value: json, bool, null, float, int or string, with its text."""
    return T.let(T.strip(value), _typed)


def _typed(v: Column) -> Column:
    low = F.lower(v)
    is_json = v.rlike(r"\A[{\[]") & F.try_parse_json(v).isNotNull()
    is_float = v.rlike(r"\A[+-]?(\d+(_\d+)*\.(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\z")
    is_int = v.rlike(r"\A[+-]?\d+(_\d+)*\z")
    in_quotes = v.rlike("(?s)\\A(\".*\"|'.*'|\"|')\\z")
    kind = F.when(is_json, "json").when(low.isin("true", "false"), "bool").when(low.isin("null", "none", "~"), "null").when(is_float, "float").when(is_int, "int").otherwise("string")
    shown = F.when(kind == "bool", low).when(kind == "null", F.lit(None).cast("string")).when(kind.isin("float", "int"), F.replace(v, F.lit("_"), F.lit("")))
    plain = F.when(in_quotes, F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))).otherwise(v)
    return F.struct(kind.alias("kind"), F.when(kind.isin("bool", "null", "float", "int"), shown).when(kind == "json", v).otherwise(plain).alias("value"))


def with_defaults(metadata: Column, missing: dict[str, str]) -> Column:
    """A JSON object's text with members (JSON text) put at its end where their names are missing."""
    own = dumped(object_or_empty(F.coalesce(metadata, F.lit("{}"))))
    names = F.json_object_keys(own)
    more = F.concat_ws(", ", F.when(own != "{}", F.substring(own, F.lit(2), F.length(own) - 2)), *[F.when(~F.array_contains(names, k), F.concat(F.lit(f'"{k}": '), F.lit(v))) for k, v in missing.items()])
    return F.concat(F.lit("{"), more, F.lit("}"))


def built(name: Column, description: Column, content: Column, metadata: Column) -> Column:
    """The text of a skill file: front matter with name, description and metadata (JSON text), then the content."""
    return F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: "), description, F.lit("\nmetadata: "), metadata, F.lit("\n---\n\n"), content)


def _field(meta: Column, name: str) -> Column:
    return typed_value(F.try_element_at(meta, F.lit(name)))["value"]


def slug_and_version(directory: Column) -> tuple[Column, Column]:
    """slug-version of a package folder, where the part after the last dash begins with a digit; else 1.0.0."""
    tail = F.regexp_extract(directory, r"^.*-([0-9][^-]*)$", 1)
    return F.when(tail != "", F.regexp_extract(directory, r"^(.*)-[0-9][^-]*$", 1)).otherwise(directory), F.coalesce(F.nullif(tail, F.lit("")), F.lit("1.0.0"))


def skills(tree: DataFrame) -> DataFrame:
    """(dir, owner, slug, version, published_at, name, description, metadata, text, scripts) of the packages of a tree.

    A package is a folder with a SKILL.md that has front matter. Its _meta.json (or meta.json, which Spark's readers
    see) gives owner, slug, version and time; without one they are unknown, the name, 1.0.0 and null. scripts are the
    files right below its scripts folder.
    """
    kinds = [("md", r"^(?:(.*)/)?SKILL\.md$"), ("meta", r"^(?:(.*)/)?_?meta\.json$"), ("script", r"^(?:(.*)/)?scripts/[^/]+$")]
    kind, folder = F.lit(None).cast("string"), F.lit("")
    for k, p in kinds:
        kind, folder = F.when(F.col("path").rlike(p), k).otherwise(kind), F.when(F.col("path").rlike(p), F.regexp_extract("path", p, 1)).otherwise(folder)
    files = tree.select(folder.alias("dir"), kind.alias("kind"), "path", "text").where("kind IS NOT NULL")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("text")))
    scripts = F.array_sort(F.collect_list(F.when(F.col("kind") == "script", F.struct(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("text").alias("text")))))
    one = files.groupBy("dir").agg(of("md").alias("md"), of("meta").alias("meta"), F.map_from_entries(scripts).alias("scripts"))
    # Told by the pattern, as a filter on what was parsed would parse it again.
    f = one.where(F.col("md").rlike(_FRONT)).withColumn("front", front_matter(F.col("md")))
    f = f.withColumn("name", F.coalesce(_field(F.col("front"), "name"), F.lit("")))
    get = lambda k, otherwise: F.when(F.col("meta").isNull(), otherwise[0]).otherwise(F.coalesce(F.get_json_object("meta", f"$.{k}"), otherwise[1]))
    return f.select(
        "dir",
        get("ownerId", (F.lit("unknown"), F.lit(""))).alias("owner"),
        get("slug", (F.col("name"), F.lit(""))).alias("slug"),
        get("version", (F.lit("1.0.0"), F.lit("1.0.0"))).alias("version"),
        F.when(F.col("meta").isNotNull(), F.coalesce(F.get_json_object("meta", "$.publishedAt").try_cast("long"), F.lit(0))).alias("published_at"),
        "name",
        F.coalesce(_field(F.col("front"), "description"), F.lit("")).alias("description"),
        object_or_empty(F.try_element_at("front", F.lit("metadata"))).alias("metadata"),
        body(F.col("md")).alias("text"),
        "scripts",
    )


def skill_text(tree: DataFrame, slug: str, version: str | None = None) -> DataFrame:
    """(slug, version, text) of a package's SKILL.md as it is, by folder name; the last version by text if none is given."""
    named = tree.where(F.col("path").rlike(r"^[^/]+/SKILL\.md$")).withColumn("folder", F.substring_index("path", "/", 1))
    if version is not None:
        return named.where(F.col("folder") == f"{slug}-{version}").select(F.lit(slug).alias("slug"), F.lit(version).alias("version"), "text")
    own, number = slug_and_version(F.col("folder"))
    some = named.select(own.alias("slug"), number.alias("version"), "text").where(F.col("slug") == slug)
    return some.orderBy(F.col("version").desc()).limit(1)


def uploaded(packages: DataFrame, known: DataFrame, words: dict[str, list[str]], now: int, owner: str, categories_at: str, embedder, suggester=None) -> DataFrame:
    """What becomes of packages (as of skills()) that are uploaded against known(slug, version, published_at).

    Categories are those of the metadata at the JSON path `categories_at`, or suggested where these are missing or
    only general. A version that is the slug's newest known one has its last number raised. Each package is compared
    with what was known before, not with others of the same call.
    """
    newest = known.groupBy("slug").agg(F.max_by("version", "published_at").alias("__newest"))
    own = F.coalesce(F.from_json(F.get_json_object("metadata", categories_at), "array<string>"), F.array().cast("array<string>"))
    plain = (F.size(own) == 0) | (own == F.array(F.lit("general")))
    suggested = T.categories(F.concat_ws(" ", "text", "description"), words, suggester)
    version = F.when(F.col("__newest") == F.col("version"), T.bump_last(F.col("version"))).otherwise(F.col("version"))
    return packages.join(newest, "slug", "left").select(
        "dir", F.lit(owner).alias("owner"), "slug", version.alias("version"), F.lit(now).cast("long").alias("published_at"), "name", "description",
        F.when(plain, suggested).otherwise(own).alias("categories"), embedder(T.embed_skill_input(F.col("name"), F.col("description"), F.col("text"))).alias("embedding"), "text", "scripts",
    )


def upload_results(paths: DataFrame, tree: DataFrame, done: DataFrame) -> DataFrame:
    """(path, dir, success, slug, version, name, error) of folders that were given for upload.

    A folder with a SKILL.md is a package itself; of any other, those right below it that have one are. Folders
    without any are reported once; packages that uploaded() lacks could not be read.
    """
    found = tree.where(F.col("path").rlike(r"(^|/)SKILL\.md$")).select(F.regexp_replace("path", r"/?SKILL\.md$", "").alias("dir"))
    parent = F.regexp_replace("dir", r"/?[^/]*$", "")
    itself = paths.join(found.select(F.col("dir").alias("path"), "dir"), "path")
    below = paths.join(itself.select("path"), "path", "left_anti").join(found.select(parent.alias("path"), "dir"), "path")
    none = paths.join(itself.select("path").unionByName(below.select("path")).distinct(), "path", "left_anti").select("path", F.lit(None).cast("string").alias("dir"))
    each = itself.select("path", "dir").unionByName(below.select("path", "dir")).unionByName(none)
    out = each.join(done.select("dir", "slug", "version", "name"), "dir", "left")
    error = F.when(F.col("dir").isNull(), "not a skill directory (no SKILL.md)").when(F.col("slug").isNull(), "failed to load skill")
    return out.select("path", "dir", error.isNull().alias("success"), "slug", "version", "name", error.alias("error"))


def simple_front_matter(text: Column, lower: bool = False) -> Column:
    """struct<meta, body> of a text between whose first two marks of three dashes stand `key: value` lines.

    Quotes at a value's ends go. Without both marks meta is empty and body the whole text.
    """
    whole = r"(?s)\A---(.*?)---(.*)\z"
    name = lambda x: T.strip(F.substring_index(x, ":", 1))
    value = lambda x: F.trim(T.strip(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x))), F.lit("'\""))

    def read(t: Column) -> Column:
        pairs = F.filter(F.split(T.strip(F.regexp_extract(t, whole, 1)), "\r\n|\n|\r"), lambda x: F.contains(x, F.lit(":")))
        entries = F.transform(pairs, lambda x: F.struct((F.lower(name(x)) if lower else name(x)).alias("key"), value(x).alias("value")))
        found = t.rlike(whole)
        return F.struct(
            F.when(found, _last_of_each(entries)).otherwise(F.create_map().cast("map<string,string>")).alias("meta"),
            F.when(found, F.ltrim(F.regexp_extract(t, whole, 2), F.lit("\n"))).otherwise(t).alias("body"),
        )

    # One value, so that a plan that takes its fields several times reads a text once.
    return T.let(text, read)


def listed(value: Column) -> Column:
    """array<string> of a value in the form [a, b], quotes taken off and blanks left out; null for other values."""
    inner = F.regexp_extract(value, r"(?s)\A\[(.*)\]\z", 1)
    items = F.transform(F.filter(F.split(inner, ","), lambda x: T.strip(x) != ""), lambda x: F.trim(T.strip(x), F.lit("'\"")))
    return F.when(value.rlike(r"(?s)\A\[.*\]\z"), items)


def name_slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def presets(tree: DataFrame) -> DataFrame:
    """(id, category, path, name, description, emoji, color, vibe, body) of markdown files with a name in their front
    matter; the category is the folder that a file stands in, and READMEs are left out."""
    md = tree.where(F.col("path").endswith(".md") & (F.lower(F.element_at(F.split("path", "/"), -1)) != "readme.md"))
    read = md.withColumn("f", simple_front_matter(F.col("text"), lower=True))
    get = lambda k: F.coalesce(F.try_element_at("f.meta", F.lit(k)), F.lit(""))
    category = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    out = read.select(category.alias("category"), "path", *[get(k).alias(k) for k in ("name", "description", "emoji", "color", "vibe")], F.col("f.body").alias("body"))
    return out.where("name <> ''").select(F.concat("category", F.lit("-"), name_slug(F.col("name"))).alias("id"), "*")


def preset_categories(rows: DataFrame) -> DataFrame:
    """(id, label, presets) of presets(): the categories with their presets in the order of paths."""
    each = F.array_sort(F.collect_list(F.struct("path", "id", "name", "description", "emoji")))
    grouped = rows.groupBy("category").agg(F.transform(each, lambda e: F.struct(e["id"], e["name"], e["description"], e["emoji"])).alias("presets"))
    return grouped.select(F.col("category").alias("id"), F.initcap(F.replace("category", F.lit("-"), F.lit(" "))).alias("label"), "presets")


# Fixed value: headings whose sections say what an agent is, not what it does.
_IDENTITY_HEADINGS = r"(?i)identity|communication|style|critical.rule|rules.you.must.follow"


def role_files(meta: Column, text: Column) -> Column:
    """map<path, text> of a preset: its sections by their headings in SOUL.md and AGENTS.md, and IDENTITY.md from its
    front matter (map); files without content are left out."""
    parts = F.filter(F.split(F.regexp_replace(text, r"(?<![^\n\r])## ", "\u0001## "), "\u0001"), lambda p: p != "")
    about = lambda p: F.startswith(p, F.lit("## ")) & F.substring_index(p, "\n", 1).rlike(_IDENTITY_HEADINGS)
    get = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit(""))
    soul, agents = F.array_join(F.filter(parts, about), ""), F.array_join(F.filter(parts, lambda p: ~about(p)), "")
    marked = F.concat(F.lit("# "), get("emoji"), F.lit(" "), get("name"), F.lit("\n"), get("vibe"), F.lit("\n"))
    named = F.concat(F.lit("# "), get("name"), F.lit("\n"), get("description"), F.lit("\n"))
    identity = F.when((get("emoji") != "") & (get("vibe") != ""), marked).when(get("name") != "", named).otherwise("")
    files = F.array(*[F.struct(F.lit(n).alias("k"), t.alias("v")) for n, t in (("SOUL.md", soul), ("AGENTS.md", agents), ("IDENTITY.md", identity))])
    return F.map_from_entries(F.filter(files, lambda e: e["v"] != ""))


def showcases(tree: DataFrame) -> DataFrame:
    """(slug, lang, name, description, emoji, short_code, agent_id, tags, body) of the markdown files in folders of a
    language. A file x.en.md is x in English wherever it stands; of several the last by folder and name counts."""
    md = tree.where(F.col("path").rlike(r"^[^/]+/[^/]+\.md$"))
    stem = F.regexp_extract("path", r"^[^/]+/([^/]+)\.md$", 1)
    read = md.withColumns({"stem": stem, "f": simple_front_matter(F.col("text"))})
    english = F.endswith("stem", F.lit(".en"))
    get = lambda k: F.coalesce(F.try_element_at("f.meta", F.lit(k)), F.lit(""))
    fields = [*[get(k).alias(k) for k in ("name", "description", "emoji", "short_code", "agent_id")], F.coalesce(listed(get("tags")), F.array().cast("array<string>")).alias("tags"), F.col("f.body").alias("body")]
    slug = F.when(english, F.regexp_replace("stem", r"\.en$", "")).otherwise(F.col("stem"))
    lang = F.when(english, "en").otherwise(F.substring_index("path", "/", 1))
    rows = read.select(slug.alias("slug"), lang.alias("lang"), "path", F.struct(*fields).alias("e")).where("e.name <> ''")
    return rows.groupBy("slug", "lang").agg(F.max_by("e", "path").alias("e")).select("slug", "lang", "e.*")


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as one JSON object, characters as they are; write.text makes it a file of JSON lines."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def archived(files: DataFrame, source: str, meta: Column) -> DataFrame:
    """Raw uploads of (path, content): id, source, payload, size, meta. Hidden files are left out."""
    shown = files.where(allowed(F.col("path"), ["*"]))
    return shown.select(F.expr("uuid()").alias("id"), F.lit(source).alias("source"), F.col("content").alias("payload"), F.octet_length("content").cast("long").alias("size"), meta.alias("meta"))


def snapshot_of(product: Column, resources: Column, collected_at: Column | None = None) -> Column:
    """A workspace as JSON text: its product, its files by path and, where given, the time."""
    fields = {"product": quoted(product), "resources": string_map(resources)}
    return members(**fields) if collected_at is None else members(**fields, collected_at=quoted(collected_at))


def from_snapshot(text: Column) -> Column:
    """struct<product, resources, collected_at> of a snapshot's text; what is missing is empty."""
    s = F.from_json(text, "product string, resources map<string,string>, collected_at string")
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.coalesce(s["product"], F.lit("")).alias("product"), F.coalesce(s["resources"], empty).alias("resources"), F.coalesce(s["collected_at"], F.lit("")).alias("collected_at"))
