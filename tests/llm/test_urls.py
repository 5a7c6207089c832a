from common import crowded, rows
from loggrove.llm import urls


def plain(url):
    """host, path and rule by straight string work."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, name, prefix in urls.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(name + prefix) > len(best[1])):
            best = (verdict, name + prefix)
    return host, path, best and best[1], best and best[0]


URLS = [
    "http://a.com/x", "http://com/", "http://com", "https://EXAMPLE.com/en/1", "https://www.example.com/en/2?x=1", "https://m.www.example.com/en/", "http://example.com/en",
    "http://x.net/es/9#top", "http://x.net/fr/", "http://x.net/de/", "http://net/es/", "http://xnet/es/", "ftp://ÀB.Example.org?q#f", "nothing", None, "", "://", "a://b://c/d",
    "http://h.com#a/b?c", "http://x.com\n/y", "http://notexample.com/en/", "http://a.b.net/es/x/y/z?a=1&b=2",
]


def pages(spark, data):
    return spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(data)], "page_id long, url string, html string").repartition(2)


def test_hosts_paths_and_rules(spark):
    found = {r["page_id"]: r for r in urls.with_rules(pages(spark, URLS)).collect()}
    for i, url in enumerate(URLS):
        r = found[i]
        assert (r["host"], r["path"], r["rule"], r["ruled"]) == plain(url), url


def test_verdicts(spark):
    many = URLS + [f"http://h{i % 7}.{'net/es' if i % 3 else 'com/de'}/{i}?utm={i}" for i in range(200)]
    docs = crowded(pages(spark, many))
    found = {r["page_id"]: r for r in urls.verdicts(docs).collect()}
    assert len(found) == len(many) and urls.verdicts(docs).columns == ["page_id", "host", "path", "rule", "verdict"]
    for i, url in enumerate(many):
        host, path, rule, verdict = plain(url)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict


def test_trees_learn_the_shape_of_labelled_urls(spark):
    """Half of the URLs of two shapes have rules; the trees must carry the verdict over to the other half."""
    rules = (("allow", "good.example", "/"), ("block", "bad.example", "/"))
    data = [f"https://{'good' if i % 2 else 'new'}.example/a/b{i}" for i in range(150)]
    data += [f"http://{'bad' if i % 2 else 'odd'}.example/{i * 7919 % 99991}{i}?a={i}&b={i * 31}&c=1" for i in range(150)]
    found = {r["page_id"]: r["verdict"] for r in urls.verdicts(pages(spark, data), rules=rules).collect()}
    right = sum(found[i] == ("allow" if i < 150 else "block") for i in range(0, 300, 2))
    assert right >= 145


def test_nothing_to_learn_from(spark):
    found = urls.verdicts(pages(spark, ["http://a.org/", "http://b.org/", None]))
    assert rows(found, "page_id", "verdict") == [(0, "allow"), (1, "allow"), (2, "allow")]
    assert urls.verdicts(pages(spark, URLS).where("false")).count() == 0


def test_every_suffix_counts(spark):
    data = [f"http://www.d{i}.t{i % 1500}/x" for i in range(3000)] + [None, "nothing"]
    shaped = urls.features(urls.with_rules(pages(spark, data))).select("page_id", "features").collect()
    assert len(shaped) == len(data)
    assert all((min(r["features"].toArray()[-4:]) > 0) == (r["page_id"] < 3000) for r in shaped)


def test_a_rare_kind_is_never_lost(spark):
    """Three blocked URLs among 3,000 allowed ones and a bound of 200: the trees still learn of them."""
    rules = (("allow", "good.example", "/"), ("block", "bad.example", "/"))
    data = [f"https://good.example/a/b{i}" for i in range(3000)] + [f"http://bad.example/{i}{i}?a={i}&b=1&c=2" for i in range(3)]
    shaped = urls.features(urls.with_rules(pages(spark, data), rules))
    assert urls.fit(shaped, rows=200) is not None


def test_the_sample_is_bounded_and_weighed(spark):
    """One hot URL, repeated, does not make the sample larger."""
    data = ["https://good.example/hot"] * 2500 + [f"https://good.example/{i}" for i in range(500)]
    labelled = urls.features(urls.with_rules(pages(spark, data), (("allow", "good.example", "/"),))).selectExpr("0.0 AS label", "features", "url", "page_id")
    chosen = urls._chosen(labelled, 100, 3000).collect()
    assert len(chosen) == 100 and {r["weight"] for r in chosen} == {30.0}
    assert urls._chosen(labelled, 3000, 3000).count() == 3000
