"""URL filter, main text and WARC round trips."""

import hashlib

import pytest

from sparkloom.llm import html_text, url_filter, warc
from sparkloom.llm.queries import RULES
from sparkloom.llm.store import new_path


def rules(spark):
    return spark.createDataFrame(RULES, "rule string, verdict string")


def plain_rule(host, path):
    best = None
    for r, v in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    return best or (None, None)


URLS = [
    "http://A.example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/", "http://com/de/a", "http://xcom/de/a",
    "http://x.com", "http://x.org", "ftp://x.org/?q=/es/", "no scheme", None, "://host/p", "http://x.com/en/a#f", "http://notexample.org/es/", "http://x.com?u=http://y.org/es/",
]


@pytest.mark.parametrize("inline", [200, 0])
def test_rules(spark, inline):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = url_filter.host_and_path(df.url)
    got = {r.page_id: r for r in url_filter.rule_of(df.withColumns({"host": host, "path": path}), rules(spark), inline).collect()}
    for i, u in enumerate(URLS):
        after = u.partition("://")[2] if u and "://" in u else ""
        cut = min([after.find(c) for c in "/?#" if c in after] or [len(after)])
        host, rest = after[:cut].lower(), after[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].rule_verdict) == plain_rule(host, path)


def test_aliases_by_links_of_many_pages(spark):
    """Chains of canonical links and redirects over 600 pages against a plain search for what hangs together."""
    import random

    rng = random.Random(11)
    urls = [f"http://{'com' if i % 50 == 0 else f'h{i}.net'}/{'de' if i % 50 == 0 else 'p'}/{i}" for i in range(600)]
    to = {i: rng.randrange(600) for i in range(600) if rng.random() < 0.55}
    red = [(urls[i], urls[j]) for i, j in to.items() if i % 2]
    pages = [(i, u, f'<head><link rel="canonical" href="{urls[to[i]]}"></head>' if i in to and i % 2 == 0 else "<p>") for i, u in enumerate(urls)]
    df = spark.createDataFrame([(*p, "own", "own", "own") for p in pages], "page_id long, url string, html string, node string, u string, hit string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, rules(spark), spark.createDataFrame(red, "src string, dst string")).collect()}
    at = list(range(600))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in to.items():
        at[top(i)] = top(j)
    blocked = {top(i) for i in range(0, 600, 50)}
    assert got == {i: "block" if top(i) in blocked else "allow" for i in range(600)}
    assert list(got.values()).count("block") > 40


def test_linked_pages_are_what_sql_says(spark, tmp_path):
    """The query over pages with canonical links and refreshes of all kinds against its recursive SQL."""
    import random

    import duckdb

    from sparkloom.llm import queries

    rng = random.Random(5)
    hosts = ["a.com", "b.org", "example.org", "c.net", "D.com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['/de/', '/fr/', '/en/', '/es/', '/x/', ''])}{rng.choice(['', '1', '12', '3?q=1&r=2', '4#f'])}" for _ in range(120)] + [None, "no scheme", "http://c.net"]
    links = ["/de/1", "k", "//c.net/x/1", "http://b.org/en/3?q=1&amp;r=2", "http://a.com/de/", "../up", "http://c.net"]
    html = lambda: rng.choice(["", None, f"<LINK rel='canonical' href='{rng.choice(links)}'>", f'<link href={rng.choice(links)} rel=canonical>', f'<meta http-equiv="refresh" content="0; URL={rng.choice(links)}">', "<p>x"])
    df = spark.createDataFrame([(i, u, html()) for i, u in enumerate(urls)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in queries.op2_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.execute(queries.ORACLE_SQL["op2_url_filter"]).fetchall())
    assert sum(v == "block" and r is None for _, _, _, r, v in got) > 5


def test_aliases(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.net/x", "<link href='/k' rel=canonical>"), (2, "http://a.net/k", ""), (3, "http://c.net/1", None), (4, "http://q.org/z", ""), (5, None, ""), (6, "foo", ""), (7, "http://z.net", ""), (8, "http://m.net/", '<meta http-equiv="refresh" content="0; url=http://b.com/de/9">'), (3, "http://c.net/1", None)],
        "page_id long, url string, html string",
    )
    red = spark.createDataFrame([("https://a.net/x", "http://b.com/de/1"), ("http://c.net/1", "https://a.net/x#f"), ("http://q.org/z", "http://c.net/1"), (None, "http://z.net")], "src string, dst string")
    got = [(r.page_id, r.verdict) for r in url_filter.judge_urls(pages, rules(spark), red).orderBy("page_id").collect()]
    assert got == [(1, "block"), (2, "block"), (3, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block")]
    assert url_filter.judge_urls(pages.limit(0), rules(spark), red).count() == 0
    assert url_filter.judge_urls(pages.withColumn("rule", pages.url), rules(spark)).columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Top bar words</header><nav><ul><li><a href=/a>a</a></li><li>b</li></ul></nav>"
    "<!-- c --><div class='ad'>Buy now words</div><article><h1>Head &amp; line</h1><p><b>One  two\nthree.<br><p>Second &lt;para&gt;.</p><p></p><ul><li>it 1</li><li>it 2</li></ul>"
    "<div class='comments'><p>a reader says this and that</p></div></article><aside>side words here</aside><form>Name</form><footer>&copy; foot</footer></body></html>"
)
TEXT = "Head & line\n\nOne two three.\n\nSecond <para>.\n\nit 1\n\nit 2"


def test_main_text():
    w = html_text.learn([PAGE] * 5)
    assert html_text.main_text(PAGE, w) == TEXT
    assert html_text.main_text(None, w) == "" and html_text.main_text("", w) == ""
    cut = PAGE[: PAGE.index("Second") + 9]
    assert html_text.main_text(cut, w) == "Head & line\n\nOne two three.\n\nSecond &lt" or html_text.main_text(cut, w).startswith("Head & line")
    assert html_text.main_text("<nav>x</nav>", w) == ""
    for n in range(0, len(PAGE), 7):
        html_text.main_text(PAGE[:n], w)


def test_parts_of_an_article():
    """Asides and comments inside an article neither end it nor come along; lists, notices in paragraphs and what has a
    class that pages do not use elsewhere stay."""
    w = html_text.learn([PAGE] * 5)
    words = lambda n: " ".join(["word"] * n)
    page = f"<body><nav><ul><li>m</li></ul></nav><article><h1>Head</h1><p>{words(100)}</p><aside><p>{words(300)}</p></aside><div class='ad'><p>{words(300)}</p></div><p class=notice>{words(80)}</p>"
    page += f"<div class='search'>find it</div><section id=comments><p>{words(200)}</p></section><table><tr><td><div><span><b>w</b></span></div></td></tr></table><ul>{'<li>i</li>' * 40}</ul></article><footer>f</footer></body>"
    want = ["Head", words(100), words(80), "find it", "w", *["i"] * 40]
    assert html_text.main_text(page, w) == "\n\n".join(want)


def test_names_that_begin_like_an_advert():
    """Only a container's whole name speaks against it."""
    w = html_text.learn([PAGE] * 5)
    keep = ["notice-board", "share-prices", "social-history", "menu-of-the-day", "related-work", "commentary", "navigation-by-stars", "adverse", "promotion-of-health"]
    drop = ["notice", "comments", "comment-list", "user-comments", "ad-slot", "ad_3", "sidebar-left", "cookie-banner", "share-buttons", "related-posts", "Newsletter", "adverts"]
    cookie = [n.replace("cookie-", "cookies-") for n in drop]
    page = "<body><article><h1>Head</h1>" + "".join(f"<div class='{n}'><p>text of {n}</p></div>" for n in [*keep, *cookie]) + "</article></body>"
    assert html_text.main_text(page, w) == "\n\n".join(["Head", *(f"text of {n}" for n in keep)])


def test_pages_that_mark_nothing():
    w = html_text.learn([PAGE.replace("Second", "Longer words in a second")] * 5)
    bare = "<body><nav><ul><li><a href=/a>one</a></li><li>two</li></ul></nav><div class='ad'>buy this now</div><h1>Head</h1><p>some words <b>and</b> more</p><p>last</p><aside>side</aside><footer>foot</footer></body>"
    assert html_text.main_text(bare, w) == "Head\n\nsome words and more\n\nlast"
    assert html_text.main_text("just words", html_text.Weights()) == "just words"


def test_hostile_markup_takes_linear_time():
    import time

    w = html_text.learn([PAGE] * 5)
    pages = ["<a " * 350_000, "<div>" * 100_000 + "x", "<b>" * 50_000 + "<div>x</div>" * 50_000, "<!--" * 250_000, "<script>" * 100_000, "<a href='" * 100_000, "</x>" * 250_000, "<p>x" * 100_000, "<" * 200_000, '<a b="' * 100_000 + ">"]
    for page in pages:
        began = time.time()
        html_text.main_text(page, w)
        assert time.time() - began < 20, page[:20]
    assert html_text.main_text("<p title='a > b'>x x x</p><p title=it's>y y y</p>", html_text.Weights()) == "x x x\n\ny y y"
    assert html_text.main_text("\u0130 w w w w w<script>a</script><p>b b b b b b", html_text.Weights()) == "\u0130 w w w w w\n\nb b b b b b"


def test_best_region_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 12))]
        a, b = html_text.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 9), (2, "u", None, 9), (3, None, "<article>" + "<p>word word</p>" * 3000 + "</article>", 9)], "page_id long, url string, html string, text int")
    w = html_text.train(df)
    got = {r.page_id: r for r in html_text.extract(df, w).collect()}
    assert got[1].text == TEXT and got[1].n_chars == len(TEXT) and got[2].text == "" and got[2].n_chars == 0
    assert got[3].text == "\n\n".join(["word word"] * 3000)
    assert html_text.extract(df.limit(0), w).count() == 0
    assert html_text.train(df.limit(0)).known is False


def test_transfer_framing():
    for p in (b"", b"a", b"x" * 40_000, "é€".encode() * 9000, b"\r\n0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(p)) == p
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n")


def test_round_trip(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 30_000
    rows = [(5, "http://a/\nb", "x" * 100), (3, "u", "x" * 100), (3, "u", "x" * 100), (9, None, "short"), (8, "u", "short"), (7, "u", None), (6, "u", ""), (1, "u", long), (2, "u", long), (None, "u", "x" * 100)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(df, new_path(spark, "warc")).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1])
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [x for x, _, g in rows if g == h and x is not None]
        revisit = len(p) >= 100 and i != min(same)
        want.append((i, hashlib.sha256(p).hexdigest(), len(p), "revisit" if revisit else "response", min(same) if revisit else None, None if revisit else p))
    have = [(r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0), new_path(spark, "warc")).count() == 0


def test_archives_of_many_members():
    import gzip

    records = [warc._record("response", {"WARC-Record-ID": f"<{i}>"}, b"block %d" % i) + b"\r\n\r\n" for i in range(5)]
    for data in (b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), b"".join(records), gzip.compress(records[0][:9]) + gzip.compress(records[0][9:] + b"".join(records[1:])) + b"\0" * 8):
        assert [b for _, b in warc.parse(b"".join(warc.members(data)))] == [b"block %d" % i for i in range(5)]
    for bad in (gzip.compress(records[0])[:-9], gzip.compress(records[0]) + b"rest"):
        with pytest.raises(ValueError):
            list(warc.members(bad))


def test_revisits_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    df = spark.createDataFrame([(i, "u", "x" * 200 if i < 6 else str(i) * 300) for i in range(9)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.plan(df).collect()}
    assert got == {i: (0 if 0 < i < 6 else None) for i in range(9)}


def test_revisits_name_the_record_that_they_refer_to(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * (200 + i % 3)) for i in (7, 4, 1, 8, 2, 1)], "page_id long, url string, html string").repartition(3).cache()
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan(df), path)
    found = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse(b"".join(warc.members(f.read_bytes())))]
    page = {h["warc-record-id"]: h["x-page-id"] for h in found}
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert len(page) == len(found) == 6 and len(revisits) == 3
    assert all(page[h["warc-refers-to"]] == h["x-refers-to-page"] for h in revisits)


def test_missing_segment_fails(spark):
    schema = warc._RECORDS
    part = lambda n, total, block: ("i", "i", n, total, "response", 1, None, None, None, block)
    whole = warc._HTTP + warc.chunked(b"abc")
    ok = spark.createDataFrame([part(2, len(whole), whole[30:]), part(1, None, whole[:30])], schema)
    assert bytes(warc.reassemble(ok).first().payload) == b"abc"
    for bad in ([part(1, None, whole[:30])], [part(1, None, whole[:30]), part(3, len(whole), whole[30:])], [part(1, None, whole[:30]), part(2, len(whole) + 1, whole[30:])]):
        with pytest.raises(Exception, match="segments missing"):
            warc.reassemble(spark.createDataFrame(bad, schema)).collect()
