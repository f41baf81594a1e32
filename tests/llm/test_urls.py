from threadgraph.llm import urls as U

ROWS = [(1, "http://a.net/x"), (2, "https://www.Example.NET/en/1?x=/y"), (3, "http://example.net/e"), (4, "http://b.example.com/de/z#f"), (5, "http://example.com/en/"), (6, "https://x.org/fr/a"), (7, "http://x.org/de/"),
        (8, None), (9, ""), (10, "no scheme"), (11, "http://notexample.com/de/"), (12, "http://HOST?q"), (13, "a://b://c/d"), (14, "http://a.net"), (15, "http://é.org/fr/" + "x" * 20000), (1, "http://a.net/x")]


def frame(spark):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in ROWS], "page_id long, url string, host string, depth int")


def brute(u):
    u = u or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_rules_like_brute_force(spark):
    none = spark.createDataFrame([], "page_id long, label double")
    got = U.judge(frame(spark), none).collect()
    assert len(got) == len(ROWS)
    want = dict(ROWS)
    for r in got:
        host, path, (rule, verdict) = brute(want[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow")
    assert U.judge(frame(spark).limit(0), none).count() == 0


def test_trees_learn(spark):
    rows = [(i, f"http://{'ads' if i % 2 else 'site'}{i}.org/{'track/' * 3 if i % 2 else 'page'}?{'a=1&b=2&c=3' if i % 2 else ''}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(300)], "page_id long, label double")
    test = U.judge(pages, labels).filter("page_id >= 300").collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in test) >= 95
