"""Markdown sections that begin with `## `: parsing, comparing and merging, as array expressions on a row's own text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import let, strip


def parsed(text: Column) -> Column:
    """array<struct<title, body>>; the first section has no title and holds what comes before the first heading."""
    # A mark before every heading at a line's beginning, then each part is its first line and the rest.
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?dm)^## ", "\u0001## "), "\u0001")
    clean = let(parts, lambda ps: F.transform(ps, lambda p, i: F.when((i < F.size(ps) - 1) & p.endswith("\n"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)))
    first = lambda p: p.startswith("## ")
    return F.transform(
        clean,
        lambda p: F.struct(
            F.when(first(p), F.substring_index(p, "\n", 1)).otherwise(F.lit("")).alias("title"),
            F.when(first(p), F.when(F.contains(p, F.lit("\n")), F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).otherwise(F.lit(""))).otherwise(p).alias("body"),
        ),
    )


def content(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.when(s["title"] != "", F.concat(s["title"], F.lit("\n"), s["body"])).otherwise(s["body"])), "\n")


def exploded(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(parsed(F.col(text))).alias("pos", "s")).select(*keep, "pos", "s.title", "s.body")


def _body_of(sections: Column, title: Column, last: bool) -> Column:
    """The body of the section with the title: the last of equals for headings, the first for the preamble."""
    hits = F.filter(sections, lambda s: s["title"] == title)
    return F.try_element_at(hits, F.lit(-1 if last else 1))["body"]


def compared(user: Column, default: Column) -> Column:
    """array<struct<title, body, kind>> of the user's sections; kind is unchanged, modified or added."""

    def kind(default: Column, s: Column) -> Column:
        other = F.when(s["title"] == "", F.coalesce(_body_of(default, F.lit(""), False), F.lit(""))).otherwise(_body_of(default, s["title"], True))
        return let(other, lambda o: F.when(o.isNull(), "added").when(strip(o) == strip(s["body"]), "unchanged").otherwise("modified"))

    return let(default, lambda d: F.transform(user, lambda s: F.struct(s["title"].alias("title"), s["body"].alias("body"), kind(d, s).alias("kind"))))


def _merged(user: Column, source: Column, target: Column) -> Column:
    """merged() of parsed texts, as sections."""

    def put(marked: Column) -> Column:
        changed = F.filter(marked, lambda s: s["kind"] == "modified")
        base = let(changed, lambda c: F.transform(target, lambda t: F.struct(t["title"].alias("title"), F.coalesce(_body_of(c, t["title"], True), t["body"]).alias("body"))))
        added = F.transform(F.filter(marked, lambda s: s["kind"] == "added"), lambda s: F.struct(s["title"].alias("title"), s["body"].alias("body")))
        return F.concat(base, added)

    return let(compared(user, source), put)


def merged(user_text: Column, source_default: Column, target_default: Column) -> Column:
    """The target's sections, those that the user changed in the user's words, then what the user added."""
    return content(_merged(parsed(user_text), parsed(source_default), parsed(target_default)))


def changes(user_text: Column, source_default: Column) -> Column:
    """How many of the user's sections the default has not, or not in these words."""
    return F.size(F.filter(compared(parsed(user_text), parsed(source_default)), lambda s: s["kind"] != "unchanged"))


TASKS = "## Active Tasks"


def task_lines(body: Column) -> Column:
    """Lines that are neither blank nor begin or end a comment."""
    return F.filter(F.split(body, "\n"), lambda x: (strip(x) != "") & ~strip(x).startswith("<!--") & ~strip(x).endswith("-->"))


def merged_tasks(user_text: Column, source_default: Column, target_default: Column) -> Column:
    """merged(), with the user's new task lines put before the first comment of the task section."""
    first_body = lambda sections: F.coalesce(_body_of(sections, F.lit(TASKS), False), F.lit(""))

    def with_tasks(s: Column, i: Column, at: Column, new: Column) -> Column:
        def put(lines: Column, cut: Column) -> Column:
            after = F.when(cut < F.size(lines), F.slice(lines, cut + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
            return F.array_join(F.concat(F.slice(lines, F.lit(1), cut), new, after), "\n")

        def marks(lines: Column) -> Column:
            return F.filter(F.transform(lines, lambda x, j: F.when(F.contains(x, F.lit("<!--")) & (j > 0), j)), lambda j: j.isNotNull())

        text = let(F.split(s["body"], "\n"), lambda lines: let(F.coalesce(F.array_min(marks(lines)), F.size(lines)), lambda cut: put(lines, cut)))
        return F.struct(s["title"].alias("title"), F.when(i + 1 == at, text).otherwise(s["body"]).alias("body"))

    def lines_put(base: Column, new: Column) -> Column:
        at = F.array_position(F.transform(base, lambda s: s["title"]), F.lit(TASKS))
        return F.when(F.size(new) == 0, content(base)).otherwise(content(let(at, lambda a: F.transform(base, lambda s, i: with_tasks(s, i, a, new)))))

    def made(user: Column, source: Column) -> Column:
        known = F.transform(task_lines(first_body(source)), strip)
        new = let(known, lambda k: F.filter(task_lines(first_body(user)), lambda x: ~F.array_contains(k, strip(x))))
        # Merged texts are parsed again: what a body holds may be a heading by then.
        base = parsed(content(_merged(user, source, parsed(target_default))))
        return let(base, lambda b: let(new, lambda n: lines_put(b, n)))

    return let(parsed(user_text), lambda u: let(parsed(source_default), lambda s: made(u, s)))


def user_lines(user_text: Column, default: Column) -> Column:
    """The user's lines that the default has not, trimmed for comparing; the whole text where there is no default."""
    known = F.transform(F.split(strip(default), "\n"), strip)
    mine = let(known, lambda k: F.filter(F.split(strip(user_text), "\n"), lambda x: (strip(x) != "") & ~F.array_contains(k, strip(x))))
    return F.when(strip(default) == "", strip(user_text)).otherwise(strip(F.array_join(mine, "\n")))


def target_path(source: Column, path: Column, target: Column, mapping: dict[tuple[str, str], dict[str, str | None]]) -> Column:
    """The path in the target product: mapped, null where it has none, else the path itself."""

    def case(out: Column, item: tuple[tuple[str, str], dict[str, str | None]]) -> Column:
        (s, p), to = item
        inner = F.lit(None).cast("string")
        for product, new in to.items():
            inner = F.when(target == product, F.lit(new)).otherwise(inner)
        return F.when((source == s) & (path == p), inner).otherwise(out)

    return F.when(source == target, path).otherwise(reduce(case, mapping.items(), path))
