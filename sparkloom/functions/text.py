"""Text expressions: redaction, keyword classes, slugs, versions, quality gates, layered summaries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and marker lists that decide results.
PATH_PATTERNS = [
    (r"/Users/[^/\s]+", "/Users/<USER>"),
    (r"/home/[^/\s]+", "/home/<USER>"),
    (r"/root", "/<ROOT>"),
    (r"C:\\Users\\[^\\s]+", r"C:\\\\Users\\\\<USER>"),
    (r"[A-Z]:\\[^\\s]*\\[^\\s]*", "<PATH>"),
]
CREDENTIAL_PATTERNS = [
    (r"sk-[a-zA-Z0-9]{20,}", "<LLM_API_KEY>"),
    (r"ghp_[a-zA-Z0-9]{36}", "<GITHUB_TOKEN>"),
    (r"gho_[a-zA-Z0-9]{36}", "<GITHUB_OAUTH_TOKEN>"),
    (r"AKIA[0-9A-Z]{16}", "<AWS_ACCESS_KEY>"),
    (r"Bearer\s+[a-zA-Z0-9\-_\.]+", "Bearer <REDACTED_TOKEN>"),
    (r"Basic\s+[a-zA-Z0-9\+/=]+", "Basic <REDACTED>"),
    (r"[\"']?[a-zA-Z_]*(?:api[_-]?key|apikey|token|secret|password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?[\w\-\.]+[\"']?", "<REDACTED_CREDENTIAL>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"1[3-9]\d{9}", "<PHONE_NUMBER>"),
]
SECURITY_MARKERS = [
    "cve-", "cwe-", "xss", "sql injection", "sqli", "ssrf", "csrf", "rce", "lfi", "rfi", "idor", "xxe", "privilege escalation", "0day", "zero-day",
    "pentest", "penetration", "malware", "ransomware", "phishing", "trojan", "backdoor", "数据泄露", "信息泄露", "未授权访问", "越权", "权限提升", "入侵",
    "攻击面", "漏洞", "安全事件", "安全告警", "违规外联", "恶意软件", "钓鱼", "勒索", "木马", "后门", "撞库", "暴破", "爆破", "暴力破解", "供应链攻击",
]
ERROR_MARKERS = [
    "traceback", "stack trace", "stacktrace", "exception:", "error:", "errno", "modulenotfound", "importerror", "syntaxerror", "typeerror", "valueerror",
    "keyerror", "attributeerror", "segmentation fault", "core dumped", "exit code", "exit status", "报错", "异常栈", "堆栈", "未捕获", "执行失败", "运行失败",
    "启动失败", "编译失败", "构建失败", "test failed", "assertionerror",
]
MEMORY_TYPES = ["pattern", "error", "security", "life", "correction", "preference"]
TRIGGER_WORDS = ["when", "trigger", "use this", "适用", "触发", "何时", "场景"]
EDGE_WORDS = ["error", "fail", "exception", "fallback", "if not", "otherwise", "异常", "失败", "回退", "边界", "注意"]
SENTENCE_ENDS = "。！？；\n.!?;"
# End of fixed values.

#: The pattern that looks for a key's name begins at every letter of a word. All that it can begin at is a quote or a word's first letter,
#: since what it finds from a later one it finds from the first; with that said, each word is looked at once.
_NAMED = CREDENTIAL_PATTERNS[6][0]
ONCE_A_WORD = {_NAMED: r"(?:[\"']|(?<![a-zA-Z_]))" + _NAMED.removeprefix(r"[\"']?")}

#: Stand-in for an entity recogniser: what regular expressions can tell. Card numbers are checked besides.
PII_PATTERNS = [(r"[\w.+-]+@[\w-]+\.[\w.-]+", "<EMAIL_ADDRESS>"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP_ADDRESS>")]
CARD_PATTERN, CARD_MARK = r"\b(?:\d[ -]?){15}\d\b", "<CREDIT_CARD>"
#: A text in which this finds nothing has nothing that the patterns above replace: each begins with, or holds, what stands here, without
#: regard to what is around it. For RE2, which reads a text once for all of them; its white space lacks the vertical tab.
SUSPECT = "(?i)" + "|".join(
    [
        r"/Users/", r"/home/", r"/root", r"[A-Z]:\\", r"sk-[a-zA-Z0-9]{20}", r"ghp_[a-zA-Z0-9]{36}", r"gho_[a-zA-Z0-9]{36}", r"AKIA[0-9A-Z]{16}", r"Bearer[\s\x0b]", r"Basic[\s\x0b]",
        r"(?:api[_-]?key|apikey|token|secret|password|passwd|pwd)[\"']?[\s\x0b]*[:=][\s\x0b]*[\"']?[\w\-\.]", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-", r"1[3-9]\d{9}",
        r"[\w.+-]@[\w-]+\.[\w.-]", r"(?:\d{1,3}\.){3}\d", r"(?:\d[ -]?){15}\d",
    ]
)
#: What counts as white space at a text's ends.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often and in whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.trim(text, F.lit(WHITE))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text has any of the words as a substring."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def marked(words: list[str]) -> str:
    """A pattern of RE2 that finds what has one of the (lower-case) words once it is lower-cased.

    Besides capitals the Kelvin sign becomes a k, and a dotted capital I an i with a dot after it."""

    def each(w: str) -> str:
        return "".join(f"[{c}{c.upper()}{'\u212a' if c == 'k' else '\u0130' if c == 'i' and n == len(w) else ''}]" if "a" <= c <= "z" else re.escape(c) for n, c in enumerate(w, 1))

    return "|".join(map(each, words))


def suspect(text: Column) -> Column:
    """Whether SUSPECT finds something in the text."""
    pattern = SUSPECT

    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        return pc.match_substring_regex(column, pattern)

    return run(text)


def ruled(text: Column) -> Column:
    """security before error before pattern, by the markers that the text has; null stays null."""
    first, second = marked(SECURITY_MARKERS), marked(ERROR_MARKERS)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        security, error = pc.match_substring_regex(column, first), pc.match_substring_regex(column, second)
        return pc.if_else(security, "security", pc.if_else(error, "error", "pattern"))

    return run(text)


def replace_all(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Regular expressions in order, without regard to case."""
    return reduce(lambda t, p: F.regexp_replace(t, "(?i)" + ONCE_A_WORD.get(p[0], p[0]), p[1]), patterns, text)


def language(text: Column) -> Column:
    """zh if more than a fifth of the characters are CJK, else en."""
    return F.when(F.regexp_count(text, F.lit("[\u4e00-\u9fff]")) / F.greatest(F.length(text), F.lit(1)) > 0.2, "zh").otherwise("en")


def without_cards(text: Column) -> Column:
    """Runs of 16 digits that pass the check of card numbers replaced by a mark."""

    def marked(t: Column) -> Column:
        found = F.filter(F.regexp_extract_all(t, F.lit(CARD_PATTERN), F.lit(0)), lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", "")))
        return F.aggregate(found, t, lambda a, c: F.replace(a, c, F.lit(CARD_MARK)))

    return let(text, marked)


def without_personal_data(text: Column, pii: list[tuple[str, str]] | None = None) -> Column:
    """Mail and network addresses and card numbers replaced; a recogniser's own patterns can take their place."""
    return without_cards(replace_all(text, PII_PATTERNS)) if pii is None else replace_all(text, pii)


def sanitize(text: Column, custom: list[tuple[str, str]] | None = None, pii: list[tuple[str, str]] | None = None) -> Column:
    """Paths, credentials, personal data, then own patterns; null and empty stay as they are."""
    clean = replace_all(replace_all(text, PATH_PATTERNS), CREDENTIAL_PATTERNS)
    # Few texts have anything to replace; the others are read once, by RE2.
    clean = F.when(suspect(text), without_personal_data(clean) if pii is None else clean).otherwise(text)
    done = replace_all(clean, (pii or []) + (custom or []))
    return F.when(text.isNull() | (text == ""), text).otherwise(done)


def memory_type(content: Column, context: Column, resolution: Column, unless: Column | None = None) -> Column:
    """security before error before pattern, by substrings of the lower-cased fields; null, with nothing read, where `unless` holds."""
    blob = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (content, context, resolution)])
    return ruled(blob if unless is None else F.when(~F.coalesce(unless, F.lit(False)), blob))


def typed(content: Column, context: Column, resolution: Column, classifier=None) -> Column:
    """The type that a classifier, a column function of the three fields, gives if it is one of the six; else the rule's."""
    if classifier is None:
        return memory_type(content, context, resolution)
    own = classifier(content, context, resolution)
    known = own.isin(MEMORY_TYPES)
    return F.when(known, own).otherwise(memory_type(content, context, resolution, known))


def token_count(text: Column) -> Column:
    """Words and single marks; stands in for a tokenizer's counter wherever one is an argument."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\w+|[^\w\s]")), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def one_line(text: Column) -> Column:
    """Trimmed, non-blank lines joined by a space."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), " ")


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9\u4e00-\u9fff]+", "-"), "^-+|-+$", ""), 1, 50)


def slug_or_unknown(text: Column) -> Column:
    """The other slug: white space, - and _ become -, what else is no letter, digit or CJK goes; empty is unknown."""
    joined = F.regexp_replace(F.lower(text), r"[\s_-]+", "-")
    clean = F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9\u4e00-\u9fff-]", ""), "^-+|-+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def bump_minor(version: Column) -> Column:
    """The second number plus 1; 1.1.0 where that is none."""
    p = F.split(version, r"\.")
    n = F.try_element_at(p, F.lit(2)).try_cast("long")
    rest = F.when(F.size(p) > 2, F.concat(F.lit("."), F.array_join(F.slice(p, 3, 1000), "."))).otherwise("")
    return F.coalesce(F.concat(F.element_at(p, 1), F.lit("."), (n + 1).cast("string"), rest), F.lit("1.1.0"))


def bump_last(version: Column) -> Column:
    """The last number plus 1; 1.0.1 where that is none."""
    p = F.split(version, r"\.")
    n = F.element_at(p, -1).try_cast("long")
    head = F.when(F.size(p) > 1, F.concat(F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), "."), F.lit("."))).otherwise("")
    return F.coalesce(F.concat(head, (n + 1).cast("string")), F.lit("1.0.1"))


def quality_bar(content: Column) -> Column:
    """At least 150 tokens (a third of the characters) and two of: three list steps, a trigger word, an edge word."""
    low = F.lower(content)
    steps = F.regexp_count(content, F.lit(r"(?:^|\n)\s*(?:\d+[.)]\s|[-*]\s)")) >= 3
    checks = steps.cast("int") + any_of(low, TRIGGER_WORDS).cast("int") + any_of(low, EDGE_WORDS).cast("int")
    return F.coalesce((F.floor(F.length(content) / 3) >= 150) & (checks >= 2), F.lit(False))


def structure_score(clarity: Column, specificity: Column, preserves: Column, given: Column) -> Column:
    score = 0.35 * F.coalesce(clarity, F.lit(0.5)) + 0.35 * F.coalesce(specificity, F.lit(0.5)) + 0.30 * F.coalesce(preserves, F.lit(1.0))
    return F.when(given, score).otherwise(F.lit(0.5))


def verification_passed(grounded: Column, contradiction: Column, given: Column) -> Column:
    return F.when(given, (F.coalesce(grounded, F.lit(0.0)) >= 0.8) & ~F.coalesce(contradiction, F.lit(False))).otherwise(F.lit(True))


def capped(text: Column, cap: int) -> Column:
    """A field within `cap` characters; 0 is no cap."""
    return truncate(text, cap) if cap > 0 else text


def _let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def merge_texts(old: Column, new: Column, cap: int) -> Column:
    """Rule merge of two fields: what holds the other, or the longer near the cap, else both with a rule between."""

    def chosen(t: Column) -> Column:
        ex, inc, o, n = t["ex"], t["inc"], t["o"], t["n"]
        longer = F.when(F.length(ex) >= F.length(inc), ex).otherwise(inc)
        near = (F.length(ex) + F.length(inc) > int(cap * 0.8)) if cap > 0 else F.lit(False)
        both = F.concat(ex, F.lit("\n\n---\n\n"), inc)
        kept = F.when(ex == "", inc).when(F.contains(o, n) | F.contains(ex, inc), ex).when(F.contains(n, o) | F.contains(inc, ex), inc).when(near, longer).otherwise(both)
        return F.when(inc == "", ex).otherwise(_let(kept, lambda k: capped(k, cap)))

    ends = F.struct(*[strip(F.coalesce(c, F.lit(""))).alias(k) for k, c in (("ex", old), ("inc", new))])
    flat = lambda t: F.struct(t["ex"].alias("ex"), t["inc"].alias("inc"), collapse(t["ex"]).alias("o"), collapse(t["inc"]).alias("n"))
    return _let(_let(ends, flat), chosen)


def merged_or_old(merged: Column, old: Column, cap: int) -> Column:
    """A merger's field, or the old one where that is empty, within the cap."""
    return capped(F.coalesce(F.nullif(merged, F.lit("")), old), cap)


def sentence_end(text: Column, pos: Column) -> Column:
    """The greatest place up to `pos` right after a sentence's end and beyond the first 80 % of it; else `pos`."""
    keep = F.floor(pos * F.lit(0.8)).cast("int")
    tail = F.substring(text, keep + 1, pos - keep)
    # Java's class needs no escape for these characters but the line feed's own form.
    snapped = F.length(F.regexp_extract(tail, "(?s)^(.*[。！？；\n.!?;])", 1))
    return F.when((pos > 0) & (snapped > 0), keep + snapped).otherwise(pos)


def truncate(text: Column, most: Column | int) -> Column:
    """The longest prefix within `most` characters less one for the mark, back to a sentence end in its last fifth,
    with a mark; for a counter of one token a character. Unchanged if it fits, empty for no budget."""
    most = F.lit(most) if isinstance(most, int) else most
    best = F.substring(text, F.lit(1), sentence_end(text, F.greatest(F.lit(1), most - 1)))
    short = F.rtrim(best, F.lit(WHITE))
    return F.when((most <= 0) | text.isNull() | (text == ""), F.lit("")).when(F.length(text) <= most, text).when(short == "", short).otherwise(F.concat(short, F.lit("…")))


def summaries(content: Column, context: Column, resolution: Column, l0: int, l1: int) -> tuple[Column, Column]:
    """(l0, l1) by rule: the first field with text on one line; then content, context, resolution by 70, 15, 15 %."""
    has = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    first = F.when(has(content), one_line(content)).when(has(context), one_line(context)).when(has(resolution), one_line(resolution)).otherwise("")
    part = lambda c, share, flat: F.when(F.coalesce(c, F.lit("")) != "", truncate(one_line(c) if flat else c, max(int(l1 * share), 1)))
    both = F.concat_ws("\n", part(content, 0.70, True), part(context, 0.15, False), part(resolution, 0.15, False))
    return truncate(first, l0), truncate(both, l1)


def summaries_or_rule(content: Column, context: Column, resolution: Column, l0: int, l1: int, summarizer=None) -> tuple[Column, Column]:
    """What a summarizer, a column function to struct<l0, l1>, gives where its l0 is not empty; else the rule's."""
    rule = summaries(content, context, resolution, l0, l1)
    if summarizer is None:
        return rule
    own = summarizer(content, context, resolution)
    given = F.coalesce(own["l0"], F.lit("")) != ""
    return F.when(given, own["l0"]).otherwise(rule[0]), F.when(given, F.coalesce(own["l1"], F.lit(""))).otherwise(rule[1])


def embed_input(kind: Column, content: Column, context: Column, resolution: Column) -> Column:
    """Text that a memory is embedded by."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return F.concat(F.lit("memory type: "), kind, F.lit(" content: "), cut(content, 300), F.lit(" context: "), cut(context, 200), F.lit(" resolution: "), cut(resolution, 200))


def embed_skill_input(name: Column, description: Column, content: Column) -> Column:
    """Text that a skill is embedded by."""
    return F.concat_ws(" ", name, description, F.substring(content, 1, 500))


def keyword_categories(text: Column, words: dict[str, list[str]], most: int = 3, otherwise: str = "general") -> Column:
    """The categories with most of their words in the lower-cased text, in order; equals as listed."""
    low = F.lower(text)
    hits = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    scored = F.array(*[F.struct((-hits(ws)).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, ws) in enumerate(words.items())])
    top = F.slice(F.array_sort(F.filter(scored, lambda e: e["n"] < 0)), 1, most)
    return F.when(F.size(top) == 0, F.array(F.lit(otherwise))).otherwise(F.transform(top, lambda e: e["c"]))


def categories(text: Column, words: dict[str, list[str]], suggester=None) -> Column:
    """A suggester's categories, a column function of the text, or where it has none those by keywords."""
    rule = keyword_categories(text, words)
    if suggester is None:
        return rule
    own = suggester(text)
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, F.slice(own, 1, 3)).otherwise(rule)


def folded(t: Column) -> Column:
    """A text without regard to case: lower case, with the sharp s as ss and the final sigma as any other."""
    return F.replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def fold_tags(tags: Column, cap: int | None) -> Column:
    """Trimmed, non-blank tags, the first spelling of each without regard to case, at most `cap` of them."""
    clean = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), strip), lambda t: t.isNotNull() & (t != ""))
    # Each tag's folded form beside it, built once a row.
    pair = F.transform(clean, lambda t: F.struct(t.alias("t"), folded(t).alias("k")))
    keep = lambda acc, e: F.when(F.exists(acc, lambda a: a["k"] == e["k"]), acc).otherwise(F.concat(acc, F.array(e)))
    out = F.transform(F.aggregate(pair, F.array().cast("array<struct<t:string,k:string>>"), keep), lambda e: e["t"])
    return F.slice(out, 1, cap) if cap else out
