"""URL filter with redirect equivalence, in DataFrame expressions only.

Longest-match rules decide first. Where no rule fits a url, its aliases do: urls tied by redirects and canonical
links form connected components, and a component with a blocked url blocks its members, except those that a rule
allows explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.store import saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number become one conditional expression; more are joined by host.
INLINE_RULES = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty for null and where there is no `://`."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def normal(url: Column) -> Column:
    """What names a url's resource: host, path and query, without scheme and fragment; null where there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (src, dst) from each page to what its canonical link or its refresh names; targets may be relative."""
    page = pages.select(F.col(url).cast("string").alias("u"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("h"))
    tag = F.regexp_extract("h", r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    other = F.regexp_extract("h", r"(?i)<link\b[^>]*\bhref\s*=[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract("h", r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    href = F.regexp_extract(F.when(tag != "", tag).otherwise(other), r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    to = F.regexp_extract(refresh, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    edges = page.select("u", F.explode(F.array(href, to)).alias("t")).where("t <> ''")
    host, path = host_and_path(F.col("u"))
    scheme = F.regexp_extract("u", r"^([^:]*):", 1)
    target = (
        F.when(F.col("t").contains("://"), F.col("t"))
        .when(F.col("t").startswith("//"), F.concat(scheme, F.lit(":"), F.col("t")))
        .when(F.col("t").startswith("/"), F.concat(scheme, F.lit("://"), host, F.col("t")))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.regexp_extract(path, r"(?s)^(.*/)?", 0), F.col("t")))
    )
    return edges.select(F.col("u").alias("src"), F.regexp_replace(target, "&amp;", "&").alias("dst"))


def rule_of(hosts: DataFrame, rules: DataFrame, inline: int = INLINE_RULES) -> DataFrame:
    """hosts(host, path, ..) with rule and rule_verdict of rules(rule, verdict): the longest that fits, else null.

    A rule is a host, then a path from its first slash. It fits its host and all subdomains if the path starts
    with the rule's path. Of equally long rules the alphabet's first wins, an allow before a block.
    """
    split = rules.where("rule IS NOT NULL").select("rule", "verdict", F.translate(F.regexp_extract("rule", "(?s)^([^/]*)", 1), _UPPER, _LOWER).alias("rh"), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("rp"))
    head = split.limit(inline + 1).collect()  # at most inline + 1 rows
    if len(head) <= inline:
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        for r in sorted(head, key=lambda r: (-len(r.rule), r.rule, r.verdict != "allow"), reverse=True):
            fits = ((F.col("host") == r.rh) | F.col("host").endswith("." + r.rh)) & F.col("path").startswith(r.rp)
            best = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
        return hosts.withColumn("__r", best).withColumns({"rule": F.col("__r.rule"), "rule_verdict": F.col("__r.verdict")}).drop("__r")
    # Each distinct (host, path) once, by every suffix of its host.
    asked = hosts.select("host", "path").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda n: F.concat_ws(".", F.slice(F.split("host", r"\."), n, F.size(F.split("host", r"\.")))))
    fits = asked.withColumn("rh", F.explode(suffixes)).join(split, "rh").where(F.col("path").startswith(F.col("rp")))
    order = F.struct(-F.length("rule"), F.col("rule"), F.when(F.col("verdict") == "allow", 0).otherwise(1))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), order).alias("r"))
    return hosts.join(best.select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict")), ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """pages with host, path, rule and verdict (columns of those names are replaced, others stay).

    rules(rule, verdict) as in rule_of. Edges come from redirects(src, dst) of urls, and from canonical links and
    refreshes in html. verdict is the rule's; without a rule 'block' if a url of the same component has a rule
    that blocks it, else 'allow'. So a rule that allows a url always wins for that url. Urls are the same resource
    if host, path and query are, told apart by a 64-bit hash. A url that is null or has no `://` has an empty host and path, fits no rule, has
    no aliases and is allowed. Repeated rows get equal results; no row is lost or made.
    """
    made = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(F.col("u"))
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url).cast("string").alias("u"))
    found = rule_of(base.withColumns({"host": host, "path": path}), rules)
    out_cols = [*[F.col(f"row.`{c}`") for c in pages.columns if c.lower() not in made], "host", "path", "rule"]
    edges = links_of(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        edges = more if edges is None else edges.unionByName(more)
    if edges is None:
        return found.select(*out_cols, F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    # Read from the pages once: links are few beside the html that they stand in.
    edges = saved(edges.where(normal(F.col("src")).isNotNull() & normal(F.col("dst")).isNotNull()).distinct(), "url-links")
    node = lambda c: F.xxhash64(normal(F.col(c)))
    group = connected_components(edges.select(node("src").alias("src"), node("dst").alias("dst")))
    # Rules of every url of a component, pages' or only named by a link. A url of a page and of a link is the same.
    ends = edges.select(F.explode(F.array("src", "dst")).alias("u")).distinct()
    blocked = rule_of(ends.withColumns({"host": host, "path": path}), rules).where("rule_verdict = 'block'").select(node("u").alias("node")).distinct()
    # A page's own url has the same host and path as its node, so blocked ends hold all that matters.
    bad = group.join(blocked, "node", "left_semi").select("component").distinct()
    hit = group.join(bad, "component", "left_semi").select("node").withColumn("hit", F.lit(True))
    asked = found.withColumn("node", F.when(F.col("rule_verdict").isNull(), F.xxhash64(normal(F.col("u")))))
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return asked.join(hit, "node", "left").select(*out_cols, verdict.alias("verdict"))
