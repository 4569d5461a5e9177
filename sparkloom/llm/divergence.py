"""Source divergence audit: how far the words of each source of a language stand from those of the others.

Plain relational: terms are exploded regexp matches, counted by group; each group is crossed with its language's kept
vocabulary, so that terms it never uses count zero; groups of a language meet in a self-join on language and term, and
their differences are summed and ranked. All arithmetic is exact, in whole numbers.

Only counts leave the tasks that read texts. The self-join has a row for each kept term and pair of sources of a language
and is summed where it is formed; no key of any exchange is a language or a source alone before that sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import saved

#: What stands between terms, which are runs of ASCII letters and of everything beyond ASCII.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and the group's documents that have it."""
    # A term of ASCII letters alone, as most are, has the same small letters by the faster function.
    small = lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    # The matches are what is left between those of the complement, at an eighth of the time of regexp_extract_all.
    found = F.transform(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), APART), ""), small)
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), found.alias("found"))
    # Every occurrence, then once more each distinct term of the document, behind the occurrences.
    each = groups.select("lang", "source", F.size("found").alias("size"), F.posexplode(F.concat("found", F.array_distinct("found"))).alias("at", "term"))
    first = F.when(F.col("at") < F.col("size"), 0).otherwise(1).cast("long")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - first).alias("n"), F.sum(first).alias("docs"))


def _p(n: Column, total: Column, vocabulary: Column) -> Column:
    """Smoothed share in billionths, whole; exact for counts of any size."""
    wide = "decimal(28,0)"
    shares = (F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast(wide)).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", shares, (total + SMOOTHING * vocabulary).cast("decimal(38,0)"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of all groups.

    Terms are the runs between matches of APART, with A-Z alone lower-cased. A language keeps the terms in at least least_docs of its documents. Each
    group (lang, source), and each language, gives each kept term p = 1 + floor(SCALE * (n + 5) / (N + 5 * V)), N the group's
    occurrences of kept terms and V their number. Part `pair`: item is each other source of the language, value the sum
    over kept terms of the absolute difference of both p. Part `term`: item is each kept term that the group has and gives a
    higher p than the language does, value the difference, the `top` highest. Ranks go by value, highest first, then by
    item in UTF-8.

    Null texts, languages and sources count as ''. A group without terms is a group; a language that keeps no term gives pairs of
    value 0 and no terms; a language with one source has no pairs. A repeated row is a further document. Other columns are ignored, an
    empty table gives an empty result.
    """
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    counts = saved(term_counts(docs, text, lang, source), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = saved(kept, "vocabulary")
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    some = counts.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"])
    totals = groups.join(some.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    # Zeros made dense: every group of a language with every kept term of it.
    dense = totals.join(kept, "lang").join(some, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = dense.join(langs, "lang")
    p = saved(p.select("lang", "source", "term", "n", _p(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"), _p(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("lang_p")), "shares")

    other = p.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    # Both directions of a pair have one sum.
    half = p.join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = p.where((F.col("n") > 0) & (F.col("p") > F.col("lang_p"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("lang_p")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


ORACLE_SQL = r"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(found) AS term FROM d) GROUP BY ALL),
    df AS (SELECT lang, term, count(*) AS docs FROM (SELECT lang, unnest(list_distinct(found)) AS term FROM d) GROUP BY ALL),
    k AS (SELECT lang, term, (SELECT sum(n) FROM c WHERE c.lang = df.lang AND c.term = df.term) AS lang_n FROM df WHERE docs >= 30),
    l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
    e AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    t AS (SELECT lang, source, sum(n) AS total FROM e GROUP BY ALL),
    p AS (SELECT e.lang, e.source, term, n, CAST(1 + CAST(1000000000 * (n + 5) AS HUGEINT) // CAST(t.total + 5 * v AS HUGEINT) AS BIGINT) AS p,
            CAST(1 + CAST(1000000000 * (lang_n + 5) AS HUGEINT) // CAST(l.total + 5 * v AS HUGEINT) AS BIGINT) AS q
        FROM e JOIN t ON e.lang = t.lang AND e.source = t.source JOIN l ON e.lang = l.lang),
    s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""
