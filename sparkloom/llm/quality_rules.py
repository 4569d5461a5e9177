"""Quality rules as a learned decision list, in DataFrame expressions only.

Sequential covering: each rule is grown condition by condition (a statistic at least, or at most, a threshold) on
one part of the labelled rows by information gain, pruned on the other part, and kept if it is precise; its rows
are then taken away and the next rule is learned, as long as the list with its exceptions gets shorter to tell. The list becomes one ordered conditional expression, so that
judging a text is a projection: nothing is moved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import hash_limit, saved

#: Bound of the labelled rows that rules are learned from.
TRAIN_ROWS = 12_000
BINS = 32
#: Covering ends when a list takes so many bits more to tell, with its exceptions, than the shortest before it.
SLACK_BITS = 64
MOST_CONDITIONS = 3
LEAST_PRECISION = 0.95
LEAST_COVERED = 4

_STATS = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "words_per_line"]


def statistics(text: Column) -> dict[str, dict[str, Column]]:
    """Column expressions of a text's statistics, in two steps: the second refers to the first's names."""
    return {
        "first": {
            "__text": F.coalesce(text.cast("string"), F.lit("")),
        },
        "second": {
            "__words": F.expr(r"array_remove(split(__text, '[\\x20\\x09-\\x0D]+'), '')"),
            "__lines": F.expr(r"filter(split(__text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        },
        "third": {
            "n_words": F.expr("CAST(size(__words) AS LONG)"),
            "word_chars": F.expr("CAST(length(array_join(__words, '')) AS LONG)"),
            "n_symbols": F.expr("CAST(length(__text) - length(translate(__text, '#*$%&|<>', '')) AS LONG)"),
            "__upper": F.expr("CAST(length(__text) - length(translate(__text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS LONG)"),
            "__bang": F.expr("CAST(length(__text) - length(translate(__text, '!?', '')) AS LONG)"),
            "__n_lines": F.expr("CAST(size(__lines) AS LONG)"),
            "n_dup_lines": F.expr("CAST(size(__lines) - size(array_distinct(__lines)) AS LONG)"),
            "__win": F.expr(
                "CASE WHEN size(__words) < 4 THEN CAST(array() AS ARRAY<LONG>) ELSE "
                "transform(arrays_zip(slice(__words, 1, size(__words) - 2), slice(__words, 2, size(__words) - 2), slice(__words, 3, size(__words) - 2)), e -> xxhash64(e.`0`, e.`1`, e.`2`)) END"
            ),
        },
        # Windows with their places, in order of their hash: equal ones are neighbours.
        "fourth": {
            "__sorted": F.expr("CASE WHEN size(array_distinct(__win)) < size(__win) THEN sort_array(transform(__win, (x, i) -> struct(x, i))) END"),
        },
        "fifth": {
            "__twice": F.expr(
                "transform(filter(arrays_zip(slice(__sorted, 1, size(__sorted) - 1), slice(__sorted, 2, size(__sorted) - 1)), e -> e.`0`.x = e.`1`.x), e -> array(e.`0`.i, e.`0`.i + 1, e.`0`.i + 2, e.`1`.i, e.`1`.i + 1, e.`1`.i + 2))"
            ),
        },
        "sixth": {
            "n_repeat_words": F.expr("CASE WHEN __sorted IS NULL THEN 0L ELSE CAST(size(array_distinct(flatten(__twice))) AS LONG) END"),
        },
    }


def _shares() -> dict[str, Column]:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "mean_word": over("word_chars", "n_words"),
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "__n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "upper_share": over("__upper", "word_chars"),
        "bang_share": over("__bang", "word_chars"),
        "words_per_line": over("n_words", "__n_lines"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }


_RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "words_per_line"]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, q): the rows of docs as structs, and the statistics of their text; null text counts as empty."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for name, step in statistics(F.col(f"row.`{text}`")).items():
        out = out.withColumns(step) if name in ("first", "fifth") else _settled(out, step)
    return out.withColumns(_shares()).select("row", F.struct(*_RESULT).alias("q"))


def _settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns computed once a row.

    As plain projections the steps would be merged into one, and arrays that a later step uses several times
    would be built anew at each use. Unpacking an array of one struct keeps them apart.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(one).alias("__step")).select(*df.columns, "__step.*")


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that meets one is dropped, with the rule named; the rest are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self, stats: str = "q") -> Column:
        """The rule that a row of statistics meets first, as text; null if none."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            test = F.expr(" AND ".join(f"{stats}.{c.sql()}" for c in rule))
            out = F.when(test, F.lit(" and ".join(c.sql() for c in rule))).otherwise(out)
        return out


def _bin(stat: str, cuts: list[float]) -> Column:
    """How many of the thresholds are at or below the statistic."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda t: t <= F.col(stat))) if cuts else F.lit(0)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", most: int = TRAIN_ROWS) -> DecisionList:
    """Learn from at most about `most` labelled rows, those whose id has a small hash; quality 0 is what rules catch.

    Labels without an id or a quality teach nothing; of an id with several labels the lowest counts. Without bad
    or good rows the list is empty.
    """
    marks = labels.select(F.col(key).cast("long").alias("k"), F.col(quality).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").groupBy("k").agg(F.min("y").alias("y"))
    total = marks.count()
    share = min(1.0, most / total) if total else 1.0
    near = F.xxhash64("k") <= hash_limit(share)
    # The chosen marks first, about `most` rows: statistics are computed for their texts alone.
    some = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).where(F.col("k").isNotNull() & near).join(F.broadcast(marks.where(near)), "k")
    stats = with_statistics(some).select("row.k", "row.y", "q.*")
    rows = saved(stats.where("NOT base_failed").select("k", "y", *[F.col(c).cast("double").alias(c) for c in _STATS]), "rules-stats")

    # Thresholds: quantiles of each statistic over all rows and over bad rows.
    qs = F.array(*[F.lit(i / BINS) for i in range(BINS + 1)])
    edges = rows.agg(
        *[F.percentile_approx(c, qs, 2000).alias(c) for c in _STATS],
        *[F.percentile_approx(F.when(F.col("y") == 0, F.col(c)), qs, 2000).alias("bad_" + c) for c in _STATS],
    ).first()
    cuts = {c: sorted({float(f"{x:.6g}") for x in (*(edges[c] or []), *(edges["bad_" + c] or []))}) for c in _STATS}
    if not any(cuts.values()):
        return DecisionList(())
    # Each statistic as the number of thresholds at or below it: about `most` rows of a few small numbers, which are
    # looked through here rather than by a job for every condition tried.
    grow = F.pmod(F.xxhash64(F.col("k"), F.lit(1)), F.lit(3)) > 0
    binned = rows.select("y", grow.alias("grow"), F.array(*[_bin(c, cuts[c]) for c in _STATS]).alias("b")).collect()  # about `most` rows
    return DecisionList(tuple(tuple(Condition(_STATS[f], at_least, cuts[_STATS[f]][b - 1]) for f, at_least, b in rule) for rule in cover([(r.y != 0, r.grow, r.b) for r in binned], [len(cuts[c]) for c in _STATS])))


Test = tuple[int, bool, int]  # statistic, at least or below, bin


def cover(rows: list[tuple[bool, bool, list[int]]], bins: list[int]) -> list[list[Test]]:
    """Rules in order for rows of (good, grown on, bins) by sequential covering; bins tells each statistic's number."""

    def fits(b: list[int], rule: list[Test]) -> bool:
        return all((b[f] >= at) == at_least for f, at_least, at in rule)

    def counts(some: list[tuple[bool, bool, list[int]]]) -> tuple[int, int]:
        good = sum(g for g, _, _ in some)
        return len(some) - good, good

    def length(rules: list[list[Test]], left: list[tuple[bool, bool, list[int]]]) -> float:
        """Bits to tell the rules, then which rows are exceptions to them."""
        choose = lambda n, k: (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)
        tests = math.log2(max(2 * sum(bins), 2))
        bad, good = counts(left)
        all_good = counts(rows)[1]
        told = sum(0.5 * (math.log2(len(r) + 1) + len(r) * tests) for r in rules)
        covered = len(rows) - len(left)
        return told + choose(covered, all_good - good) + choose(len(left), bad)

    rules: list[list[Test]] = []
    left = rows
    shortest, stay = length(rules, left), 0
    while True:
        rule: list[Test] = []
        grown = [r for r in left if r[1]]
        while len(rule) < MOST_CONDITIONS:
            p0, n0 = counts(grown)
            if p0 == 0 or n0 == 0:
                break
            best: tuple[float, Test | None] = (1e-9, None)
            for f, number in enumerate(bins):
                by = [[0, 0] for _ in range(number + 1)]
                for good, _, b in grown:
                    by[b[f]][good] += 1
                p = n = 0
                for at in range(number, 0, -1):
                    p, n = p + by[at][0], n + by[at][1]
                    for at_least, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        if pp >= LEAST_COVERED:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0]:
                                best = (gain, (f, at_least, at))
            if best[1] is None:
                break
            rule.append(best[1])
            grown = [r for r in grown if fits(r[2], rule[-1:])]
        if not rule:
            break
        # Prune: the beginning of the rule that does best on the other rows; then the whole must be precise.
        tried = []
        for k in range(1, len(rule) + 1):
            met = [r for r in left if fits(r[2], rule[:k])]
            p, n = counts([r for r in met if not r[1]])
            all_p, all_n = counts(met)
            if all_p >= LEAST_COVERED and all_p / max(all_p + all_n, 1) >= LEAST_PRECISION:
                tried.append(((p - n) / (p + n) if p + n else -1.0, -k))
        if not tried:
            break
        rules.append(rule[: -max(tried)[1]])
        left = [r for r in left if not fits(r[2], rules[-1])]
        bits = length(rules, left)
        if bits < shortest:
            shortest, stay = bits, len(rules)
        elif bits > shortest + SLACK_BITS:
            break
    return rules[:stay]


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule and kept.

    Columns of those names are replaced, others stay. kept is false if base_failed (fewer than 50 words, or more
    than half of them in repeated windows), else whether no rule is met; rule names the one met. Null text counts
    as empty. Every row is judged by itself: repeated rows get equal results, an empty table an empty one.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    made = [*names, "rule", "kept"]
    rule = F.when(~F.col("q.base_failed"), rules.verdict())
    base = with_statistics(docs, text).select("row", *[F.col(f"q.{n}").alias(n) for n in names], rule.alias("rule"))
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in made]
    return base.select(*own, *names, "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
