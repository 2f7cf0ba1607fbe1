from urllib.parse import quote

from chalkline.llm import urlfilter
from chalkline.llm.queries import RULES
from tests.llm.conftest import with_clashes

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def plain(url, rules):
    """Host, path and rule, step by step."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for action, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return host, path, best


URLS = ["https://a.Example.COM/en/x?q=1#z", "http://www.example.com/en/y", "http://x.net/es/", "http://x.net/ES/", "https://net/fr/a", "ftp://example.com",
        "https://example.com?x/en/", "no scheme at all", None, "", "://", "http:///path", "http://user@Host.org:80/a/b", "https://x.net/fr/#://y.com/",
        "https://éXample.İ.com/a\nb", "http://a.b.co.uk/" + "x" * 20_000, "http://10.0.0.1/a", "http://xexample.com/en/", "http://com/"]


def test_parts_and_rules(spark):
    pages = with_clashes(spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], PAGES))
    got = {r.page_id: r for r in urlfilter.judge_urls(pages, spark.createDataFrame([], LABELS), RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, best = plain(u, RULES)
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (best and best[1])
        assert got[i].verdict == (best[0] if best else "allow")


def test_levels(spark):
    hosts = ["a.b.co.uk", "x.y.example.com", "example.com", "com", "10.0.0.1", "u@h.org:80", "", "[::1]:80", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urlfilter.host_levels(df["host"])
    got = [tuple(r) for r in df.select(domain, suffix).collect()]
    assert got == [("b.co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("com", ""), ("10.0.0.1", ""), ("h.org", "org"),
                   ("", ""), ("[::1]", ""), ("co.uk", "uk")]


def test_reputation_shrinks(spark):
    pages, labels = [], []

    def host(name, n, bad, seen=True):
        for i in range(n):
            page = len(pages)
            pages.append((page, f"http://{name}/{quote(str(i))}", None))
            if seen:
                labels.append((page, 0 if i < bad else 1, 0))
    for k in range(20):
        host(f"good{k}.org", 40, 2)
        host(f"h{k}.bad.org", 30, 24)
    host("tiny.org", 1, 1)
    host("sub.bad.org", 3, 0, seen=False)
    host("one.bad.org", 1, 0)
    rows = urlfilter.judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), []).collect()
    verdict = {r.host: r for r in rows}
    assert verdict["h0.bad.org"].verdict == "block" and verdict["good0.org"].verdict == "allow"
    # one bad page is not enough; an unseen host of a bad domain inherits its rate, with a wider bound
    assert verdict["tiny.org"].verdict == "allow" and verdict["tiny.org"].bad_rate > verdict["good0.org"].bad_rate
    assert verdict["sub.bad.org"].bad_rate > 0.6
    assert 0.4 < verdict["one.bad.org"].bad_rate < verdict["h0.bad.org"].bad_rate


def test_messy(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", None), (1, "http://a.org/", None), (None, "http://b.org/", None)], PAGES)
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 0), (None, 0, 1), (2, None, None)], LABELS)
    rows = urlfilter.judge_urls(pages, labels, RULES).collect()
    assert len(rows) == 3
    assert urlfilter.judge_urls(pages.limit(0), labels, RULES).count() == 0
