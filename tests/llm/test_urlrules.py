import random
import re

import pytest

from panelwright.llm.urlrules import HOST_RULES, PATTERNS, HostRule, Pattern, judge, judge_sql, rarest_token_index


def brute(url, host_rules, patterns):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in host_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)] if host else []
    if fits:
        best = max(fits, key=lambda r: (len(r.name), r.name))
        return host, path, best.name, best.verdict
    hits = {p.verdict for p in patterns if re.search(p.regex, (url or "").lower())}
    return host, path, None, "block" if hits == {"block"} else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "https://Example.NET/en/1", "http://a.b.example.net/EN/1", "http://example.net/en", "http://x.net", "http://x.net?y=/en/",
    "http://notexample.com/de/1", "http://example.com/de/1?utm_source=feed", "http://blog.example.com/en/4?utm_source=feed", "http://example.com/en/4?utm_source=feed&x=1",
    "http://example.com/a?utm_source=feeds", "http://example.org/fr/9#top", "http://example.org/login", "http://example.org/logins", "http://ads.example.org/x", "http://loads.example.org/x",
    "http://example.org/file.exe", "http://example.org/file.exe?x", "javascript:alert(1)", "http://example.org/cart/7/checkout", "ftp://USER@HOST.org:80/tag/x/feed/", "http://é.org/ñ?sessionid=1",
    "http://example.org/" + "a/" * 50_000,
]


@pytest.fixture
def pages(spark):
    def make(urls):
        rows = [(i, u, "html", "clash") for i, u in enumerate(urls)]
        return spark.createDataFrame(rows, "page_id long, url string, html string, host string")

    return make


def random_urls(n):
    rng = random.Random(2)
    part = lambda: rng.choice(["login", "en", "es", "de", "fr", "tag", "feed", "cart", "checkout", "m", "ads", "x.html", "y.zip", "?page=2&ref=x", "?utm_source=feed"])
    return [f"http://{part()}.example.{rng.choice(['com', 'org', 'net'])}/" + rng.choice("/.").join(part() for _ in range(rng.randint(0, 4))) for _ in range(n)]


def test_verdicts_by_brute_force(pages):
    urls = URLS + random_urls(800)
    found = judge(pages(urls), HOST_RULES, PATTERNS).collect()
    assert len(found) == len(urls)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], HOST_RULES, PATTERNS), urls[r.page_id]


def test_only_filed_rules_run_and_none_is_missed():
    patterns = [Pattern(t, "block") for t in ("/aa/bb*cc", "*free*", "aa^bb|", "^cc^aa^")]
    index = rarest_token_index(patterns, {"aa": 50, "bb": 3, "cc": 7})
    assert index == {"aa": [0], None: [1], "bb": [2], "cc": [3]}
    rng = random.Random(1)
    for _ in range(3000):
        url = "".join(rng.choice(["aa", "bb", "cc", "/", ".", "free", "x"]) for _ in range(rng.randint(1, 8)))
        tokens = {None, *re.findall("[a-z0-9]+", url)}
        for i, p in enumerate(patterns):
            if re.search(p.regex, url):
                assert any(i in index.get(t, ()) for t in tokens), (url, p)


def test_equals_sql(pages):
    duckdb = pytest.importorskip("duckdb")
    urls = URLS + random_urls(300)
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in judge(pages(urls), HOST_RULES, PATTERNS).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert set(con.execute(judge_sql(HOST_RULES, PATTERNS)).fetchall()) == found


def test_edges(pages):
    assert judge(pages([]), HOST_RULES, PATTERNS).count() == 0
    assert judge(pages(["http://a.org/x"] * 3), [], []).collect()[0].verdict == "allow"
    assert judge(pages(["http://a.org/x/y"]), [HostRule("a.org", "/x", "block"), HostRule("org", "/x/y", "allow")], []).collect()[0].rule in {"a.org/x", "org/x/y"}


def test_patterns_in_any_case_and_a_final_line_feed(pages):
    urls = ["http://a.com/Login", "http://a.com/login\n", "http://a.com/x.exe", "http://a.com/x.exe\n", "http://a.com/X.EXE", "http://a.com/exe", "http://a.com/FREE/stuff"]
    patterns = [Pattern("/LogIn^", "block"), Pattern(".EXE|", "block"), Pattern("/free/", "allow"), Pattern("*Stuff", "block")]
    assert patterns[0].tokens == ["login"] and patterns[3].tokens == []
    found = {r.page_id: (r.verdict, r.pattern) for r in judge(pages(urls), [], patterns).collect()}
    login, exe = ("block", "/LogIn^"), ("block", ".EXE|")
    assert found == {0: login, 1: login, 2: exe, 3: ("allow", None), 4: exe, 5: ("allow", None), 6: ("allow", "/free/")}


def test_line_feeds_and_cases_agree_with_sql(pages):
    import duckdb

    urls = [u + end for u in URLS[4:26] for end in ("", "\n", "\r\n")] + ["http://A.com/X.ZIP\n", "http://A.com/LOGIN\n", "HTTP://a.com/Login"]
    patterns = [*PATTERNS, Pattern("/LOGINS|", "block"), Pattern("://Ads.", "allow")]
    table = pages(urls)
    con = duckdb.connect()
    con.register("pages", table.select("page_id", "url").toPandas())
    columns = ["page_id", "host", "path", "rule", "verdict", "pattern"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({judge_sql(HOST_RULES, patterns)}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in judge(table, HOST_RULES, patterns).select(*columns).orderBy("page_id").collect()] == want
