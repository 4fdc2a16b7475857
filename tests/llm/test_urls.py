from itertools import combinations

from pyspark.sql import functions as F

from cobaltmill.llm import urls


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for sign in "/?#":
        host = host.split(sign, 1)[0]
    path = rest[len(host):]
    for sign in "?#":
        path = path.split(sign, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.LISTED
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = [None, "", "no scheme", "http://", "https://Example.COM/en/x?y#z", "http://www.example.com/en/", "x://com/", "x://com",
        "http://acom/en/", "http://a.net/es/1", "http://net/fr/", "http://net/de/", "http://ÄÖ.net/es/é", "a://b://c.com/d",
        "http://u:p@example.com:80/en/", "http://example.com?/en/", "http://example.com/EN/", "http://.com/", "http://x..net/fr/z#?",
        "http://example.com/en\n/", "https://sub.www.example.com/en/q", "http://a.org/" + "p/" * 3000 + "1"]


def test_listed_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, None), (3, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn(
        "tokens", F.lit(1))
    none = spark.createDataFrame([], "tokens array<string>, bad boolean")
    found = urls.judge(pages, urls.mine(none)).collect()
    assert len(found) == len(rows)
    want = []
    for i, u in rows:
        host, path = plain(u)
        fit = rule_of(host, path)
        want.append((i, host, path, fit and fit[0], fit[1] if fit else "allow", None))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def brute_rules(baskets, support, confidence, lift):
    n, out = len(baskets), {}
    items = sorted({t for b, _ in baskets for t in b})
    base = sum(bad for _, bad in baskets) / n
    for size in (1, 2, 3, 4):
        for combo in combinations(items, size):
            inside = [bad for b, bad in baskets if set(combo) <= set(b)]
            if inside and sum(inside) >= support * n and sum(inside) / len(inside) >= confidence \
                    and sum(inside) / len(inside) / base >= lift:
                out[combo] = sum(inside) / len(inside)
    return out


def test_mined_rules_equal_brute_force(spark):
    baskets = []
    for i in range(240):
        tokens = [t for k, t in enumerate(("a", "b", "c", "d")) if (i * (k + 3) // 5) % 2]
        baskets.append((tokens, {"a", "b"} <= set(tokens) or i % 11 == 0))
    baskets = [(t, b) for t, b in baskets if t]
    found = urls.mine(spark.createDataFrame(baskets, "tokens array<string>, bad boolean"), 0.02, 0.5, 1.1).collect()
    want = brute_rules(baskets, 0.02, 0.5, 1.1)
    assert {tuple(r["tokens"]): round(r["confidence"], 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
    assert want and all(r["anchor"] in r["tokens"] for r in found)


def test_tokens_that_come_together_are_mined_as_one(spark):
    """The verdicts are those of all combinations; 25 query names that come together end in time."""
    names = [f"n{k}" for k in range(4)]
    baskets = [((["a", "b"] if i % 2 else ["a"]) + (names if i % 3 == 0 else []) + ["u", "v"], i % 6 == 3 or i % 13 == 0)
               for i in range(260)]
    rules = urls.mine(spark.createDataFrame(baskets, "tokens array<string>, bad boolean"), 0.02, 0.3, 1.1)
    every = brute_rules(baskets, 0.02, 0.3, 1.1)  # has all rules of up to four tokens
    given = [["n2"], ["b", "n1"], ["a"], ["b", "n3", "new"], ["n0", "n1", "b", "u"], [], ["v", "b"], ["new"], ["a", "b", "v", "n0"]]
    frame = spark.createDataFrame([(str(k), t) for k, t in enumerate(given)], "url string, tokens array<string>")
    found = {r["url"]: round(r["confidence"], 9) for r in urls.match(frame, rules).collect()}
    want = {str(k): [c for need, c in every.items() if set(need) <= set(t)] for k, t in enumerate(given)}
    assert found == {k: round(max(v), 9) for k, v in want.items() if v} and found
    assert rules.count() < len(every)

    many = "&".join(f"q{k}=1" for k in range(25))
    pages = [(i, f"http://x.org/{i}" + (f"?{many}" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame([(i, u.replace("?", "/%d?" % i)) for i, u in pages], "page_id long, url string")
    rules = urls.mine(urls.page_labels(frame, labels))
    assert rules.count() < 100
    assert {r["page_id"] for r in urls.judge(frame, rules).filter("verdict = 'block'").collect()} == set(range(0, 400, 4))


def test_mined_rules_block(spark):
    pages = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.site.org/{'promo' if i % 2 else 'news'}/{i}") for i in range(600)]
    pages += [(1000, None), (1001, "http://bad.site.org/promo/x?ref=1"), (1002, "http://bad.site.org/other/9")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(
        [(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(600)] + [(None, 0, 1), (5, None, None)],
        "doc_id long, quality int, toxic int")
    rules = urls.mine(urls.page_labels(frame, labels), 0.05, 0.9, 1.2)
    found = {r["page_id"]: r for r in urls.judge(frame, rules).collect()}
    assert all(found[i]["verdict"] == ("block" if i % 3 == 0 and i % 2 else "allow") for i in range(600))
    assert found[1001]["verdict"] == "block" and found[1002]["verdict"] == found[1000]["verdict"] == "allow"


def test_whole_table(spark, sf):
    from cobaltmill.session import table
    found = urls.query(spark, sf).collect()
    pages = {r["page_id"]: r["url"] for r in table(spark, sf, "pages").collect()}
    assert len(found) == len(pages)
    for r in found:
        host, path = plain(pages[r["page_id"]])
        fit = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit and fit[0])
        assert r["verdict"] == fit[1] if fit else r["verdict"] in ("allow", "block")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judge(pages, urls.mine(urls.page_labels(pages, labels))).count() == 0
