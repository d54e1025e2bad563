from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from panelwright.llm.q_url_rules import RULES
from panelwright.llm.url_rules import judge_urls, matched_rules, mine_rules, url_tokens


def test_host_path_and_longest_rule(spark):
    urls = {"https://a.example.net/en/x?q=1": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://EXAMPLE.net/en": ("example.net", "/en", "net/", "block"),
            "http://b.example.com/de/#t": ("b.example.com", "/de/", "example.com/de/", "block"), "x://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
            "http://z.org/fr/a": ("z.org", "/fr/a", "org/fr/", "allow"), "http://s.net": ("s.net", "", None, "allow"), "http://s.net?a=/": ("s.net", "", None, "allow"),
            "no scheme/net/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
            "http://u.net/\nline": ("u.net", "/\nline", "net/", "block")}
    df = spark.createDataFrame([(i, u, "x", 2) for i, u in enumerate([*urls, None])], "page_id long, url string, verdict string, n_rules int")
    none = spark.createDataFrame([], "tokens array<string>, confidence double, n long")
    out = judge_urls(df, none, RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [*urls.values(), urls[None]]
    assert judge_urls(df.where("false"), none, RULES).count() == 0


def labelled(spark):
    rows = []
    for i in range(120):
        host = ["spam.example.org", "fine.example.org", "other.example.com"][i % 3]
        path = ["casino", "news"][i // 3 % 2]
        bad = host.startswith("spam") and path == "casino" or i % 11 == 0
        rows.append((f"http://{host}/{path}/{i}?ref=x" if i % 5 else f"https://{host}/{path}/{i}#top", bad))
    return spark.createDataFrame([*rows, (None, True), ("junk", None)], "url string, bad boolean")


def test_rules_equal_all_token_sets(spark):
    df = labelled(spark)
    rules = mine_rules(df, min_support=0.01, min_count=4, min_confidence=0.7)
    every, bad = Counter(), Counter()
    for r in df.select(url_tokens(F.col("url")).alias("t"), "bad").collect():
        for k in range(1, len(r["t"]) + 1):
            for s in combinations(sorted(r["t"]), k):
                every[s] += 1
                bad[s] += bool(r["bad"])
    expected = {s: bad[s] / every[s] for s in every if bad[s] >= 4 and bad[s] / every[s] >= 0.7}
    found = {tuple(r["tokens"]): r["confidence"] for r in rules.collect()}
    assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-9 for s in found)
    assert ("host:spam", "path:casino") in found

    urls = df.where("url IS NOT NULL").distinct()
    tokens = {r["url"]: set(r["t"]) for r in urls.select("url", url_tokens(F.col("url")).alias("t")).collect()}
    fits = {u: sum(set(s) <= t for s in expected) for u, t in tokens.items()}
    assert {r["url"]: r["n_rules"] for r in matched_rules(urls, rules).collect()} == {u: n for u, n in fits.items() if n}
    pages = urls.withColumn("page_id", F.lit(1))
    assert all(r["verdict"] == ("block" if fits[r["url"]] else "allow") for r in
               judge_urls(pages, rules, [], keep=("page_id", "url")).collect())


def test_no_labels(spark):
    assert mine_rules(labelled(spark).where("false")).count() == 0


def test_a_host_is_caught_at_every_size(spark):
    """Twenty bad pages of a host make a rule among few labels and among many; half of them bad, or too few, make none."""
    for others in (500, 20_000):
        rows = [(f"http://spam.org/{i}", True) for i in range(20)] + [(f"http://few.org/{i}", True) for i in range(19)]
        rows += [(f"http://half.org/{i}", i % 2 == 0) for i in range(60)] + [(f"http://site{i % 7}.com/{i}", i % 10 == 0) for i in range(others)]
        rules = mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), bound=5.0)
        found = {tuple(r["tokens"]): (r["confidence"], r["n"]) for r in rules.collect()}
        assert found[("host:spam",)] == (1.0, 20) and not any({"host:few", "host:half"} & set(t) for t in found)
        assert not any(t[0].startswith("host:site") for t in found)


def test_bound_prunes_what_chance_explains(spark):
    """20 of 33 bad where 3 of 10 are: sixty in a hundred, but within five standard errors of the base."""
    rows = [(f"http://odd.org/{i}", i < 20) for i in range(33)] + [(f"http://rest.com/{i}", i % 10 < 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert ("host:odd",) in {tuple(r["tokens"]) for r in mine_rules(df).collect()}
    assert mine_rules(df, bound=5.0).count() == 0
