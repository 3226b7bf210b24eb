"""Hosts, paths, rules and the tree of templates."""

import re

from ledgerline.llm.queries import URL_RULES
from ledgerline.llm.url_filters import host_of, judge, path_of

URLS = [
    None, "", "no scheme", "http://A.B.com", "http://a.com/x?y#z", "https://a.com?q=1", "a://b://c/d", "http://é.net/es/ü",
    "http://x.com/p://q/r", "ftp://h/#f", "http://h/a/b/c/d/e/f", "http://WWW.Example.com/en/1", "http://example.com/en/2",
    "http://m.example.com/en/2", "http://notexample.com/en/3", "http://net/es/1", "http://a.net/es", "http://a.net/fr/1",
    "http://com", "http://x.community/", "http://h\n2/a\nb", "http://",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def test_hosts_and_paths(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: (r["h"], r["p"]) for r in df.select("page_id", host_of("url").alias("h"), path_of("url").alias("p")).collect()}
    assert [got[i] for i in range(len(URLS))] == list(map(plain, URLS))


def test_the_longest_rule_wins(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(df, labels, URL_RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = plain(url)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert got[i] == want, url


def test_templates_follow_their_labels(spark):
    """Ids are wildcards; a section whose pages are bad is rejected, its siblings are not."""
    rows = [(i, f"http://h/{section}/{slug}{i}/v{i % 3}") for i, (section, slug) in enumerate(
        [("good", "page"), ("bad", "Page"), ("mixed", "a")] * 60)]
    rows += [(500 + i, f"http://h/s{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(60)]
    labels = [(i, "/bad/" in u) for i, u in rows if i < 120] + [(0, None), (None, True), (3, False), (3, False)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in judge(df, spark.createDataFrame(labels, "page_id long, bad boolean"), ()).collect()}
    assert {got[i]["verdict"] for i, u in rows if "/bad/" in u} == {"block"}
    assert {got[i]["verdict"] for i, u in rows if "/good/" in u or "/mixed/" in u} == {"allow"}
    assert got[1]["template"] == "/bad/Page#/v#" or got[1]["template"].startswith("/*") or got[1]["template"].startswith("/bad/")


def test_edges(spark):
    kind = "page_id long, url string, host string, verdict int, bad string"
    df = spark.createDataFrame([(None, "http://a.com/", "", 1, ""), (1, None, "", 1, ""), (1, None, "", 1, "")], kind)
    labels = spark.createDataFrame([(1, True), (1, False), (None, True)], "page_id long, bad boolean")
    got = sorted(((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in judge(df, labels, URL_RULES).collect()), key=str)
    assert got == sorted([(None, "a.com", "com/", "allow")] + [(1, "", None, got[0][3])] * 2, key=str)
    assert judge(df.filter("false"), labels, URL_RULES).count() == 0


def verdicts(spark, urls, labels):
    """Rows of the judged urls by url; ``labels``: whether it is bad, by page number."""
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")
    return {r["path"]: r for r in judge(rows, marks, ()).collect()}


def letters(i):
    return chr(97 + i // 26) + chr(97 + i % 26)


def test_frequent_segments_keep_their_node_beside_rare_ones(spark):
    """The pages below /good and /bad have equal names; 60 sections have one page each."""
    urls = [f"http://h/{'bad' if i % 2 else 'good'}/page{i}" for i in range(120)] + [f"http://h/s{letters(i)}/page1" for i in range(60)]
    got = verdicts(spark, urls, {i: i % 2 == 1 for i in range(80)})
    assert {r["verdict"] for p, r in got.items() if p.startswith("/bad/")} == {"block"}
    assert {r["verdict"] for p, r in got.items() if p.startswith("/good/")} == {"allow"}
    assert {r["template"] for r in got.values()} == {"/bad/page#", "/good/page#", "/*/page#"}


def test_branches_part_at_any_depth(spark):
    """The fifth segment tells good from bad; a trailing slash and a path's end are branches too."""
    urls = [f"http://h/blog/2024/{i % 12}/{'spam' if i % 2 else 'news'}/x{letters(i)}" for i in range(160)]
    urls += ["http://h/" + "/".join("abcdefghijklmnop"), "http://h/blog/2024", "http://h/blog/2024/", "http://h", "http://i/a/b/c/d/e/1"]
    got = verdicts(spark, urls, {i: i % 2 == 1 for i in range(100)})
    assert len(got) == len(urls)
    assert {r["verdict"] for p, r in got.items() if "/spam/" in p} == {"block"}
    assert {r["verdict"] for p, r in got.items() if "/news/" in p} == {"allow"}
    shapes = {p: r["template"] for p, r in got.items()}
    assert {t for p, t in shapes.items() if "/spam/" in p} == {"/blog/#/#/spam/*"}
    assert shapes["/a/b/c/d/e/1"] == "/a/b/c/d/e/#" and shapes["/" + "/".join("abcdefghijklmnop")] == "/" + "/".join("abcdefghijklmnop")
    assert (shapes["/blog/2024"], shapes["/blog/2024/"], shapes[""]) == ("/blog/#", "/blog/#/", "/")


def test_like_siblings_are_pooled(spark):
    """Eight sections with three bad labels each beside a big clean one; one with clean labels stays apart."""
    urls = [f"http://h/news/{i}" for i in range(2000)] + [f"http://h/s{letters(j)}/{i}" for j in range(8) for i in range(3)]
    labels = {i: i >= 2000 or i % 50 == 0 for i in range(2024)}
    urls += [f"http://h/ok/{i}" for i in range(3)] + [f"http://h/s{letters(j)}/9" for j in range(8)] + ["http://h/ok/9"]
    got = verdicts(spark, urls, labels | {i: False for i in range(2024, 2027)})
    assert {r["verdict"] for p, r in got.items() if p.startswith("/s")} == {"block"}
    assert {r["verdict"] for p, r in got.items() if not p.startswith("/s")} == {"allow"}
    p = 65 / 2029
    assert abs(got["/saa/9"]["bad_share"] - (24 + 8 * p) / 32) < 1e-9


def test_labels_count_once_on_a_short_path(spark):
    """Four bad labels of a host are smoothed by eight pages, however many levels there are."""
    urls = [f"http://h/news/{i}" for i in range(200)] + [f"http://x/a/{i}" for i in range(200, 204)] + ["http://x/a/b/c/d/e"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([(i, i >= 200) for i in range(204)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in judge(rows, marks, ()).collect()}
    assert abs(got[200]["bad_share"] - (4 + 8 * 5 / 206) / 12) < 1e-9 and got[200]["verdict"] == "allow"
