from collections import Counter
from itertools import combinations

from rankloom.llm import url_rules as U


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def listed(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def brute(rows, support, confidence):
    """Every combination of tokens of the labelled urls, counted."""
    sets = {u: frozenset(t) for u, t in rows}
    known = [(sets[u], listed(*host_path(u))[2]) for u in sets_in_order(rows) if listed(*host_path(u))]
    n, counts, by = len(known), Counter(), Counter()
    for s, v in known:
        for k in range(1, len(s) + 1):
            for c in combinations(sorted(s), k):
                counts[c] += 1
                by[c, v] += 1
    rules = {(c, v): (x / counts[c], x / n) for (c, v), x in by.items() if x >= support * n and x / counts[c] >= confidence}
    kept = {
        (c, v): r for (c, v), r in rules.items()
        if not any(set(d) < set(c) and s[0] >= r[0] for (d, _), s in rules.items())
    }
    out = {}
    for u, s in sets.items():
        fits = [(r[0], r[1], len(c), v) for (c, v), r in kept.items() if set(c) <= s]
        out[u] = max(fits)[3] if fits else None
    return out


def sets_in_order(rows):
    return [u for u, _ in rows]


def test_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host, path = U.host_and_path("url")
    rows = [(r["url"], r["t"]) for r in pages.select("url", U.tokens(host, path, U.F.col("url")).alias("t")).collect()]
    want = brute(rows, 0.1, 0.8)
    by_id = {r["page_id"]: r["url"] for r in pages.collect()}
    out = U.judge(pages, support=0.1, confidence=0.8).collect()
    assert len(out) == len(by_id)
    for r in out:
        url = by_id[r["page_id"]]
        assert (r["host"], r["path"]) == host_path(url)
        rule = listed(r["host"], r["path"])
        assert r["rule"] == (rule[1] if rule else None)
        assert r["verdict"] == (rule[2] if rule else want[url] or U.DEFAULT)
        assert r["mined"] == (rule is None and want[url] is not None)


def test_odd_urls(spark):
    urls = [
        None, "", "nothing", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/en/12", "http://org", "http://org/", "ftp://b.com/fr/", "://x.com/de/1?a=b#c",
        "http://x.com?u=http://y.org/es/", "http://notorg/de/", "http://ÉX.org/É#z", "http://com/de/\nx", "http://x.org:80/a", "http://example.org/en/2", "http://b.com/fr",
    ]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(3, "http://"
        , "x", 1), (None, "http://org/", "x", 2)], "page_id bigint, url string, rule string, items int")
    out = U.judge(pages).collect()
    assert len(out) == len(urls) + 2
    for r in out:
        if r["page_id"] is not None:
            url = urls[r["page_id"]]
            assert (r["host"], r["path"]) == host_path(url), url
            rule = listed(*host_path(url))
            assert r["rule"] == (rule and rule[1]) and r["verdict"] in ("allow", "block") and (not rule or r["verdict"] == rule[2])
    assert U.judge(pages.limit(0)).count() == 0
