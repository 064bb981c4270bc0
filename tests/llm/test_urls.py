import random
import re

import pytest

from topicspark.llm.urls import PATTERN_RULES, SITE_RULES, literals, rule_grams, rule_index, rule_regex, rule_tokens, url_verdicts

CASES = [
    ("https://Example.COM/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.b.com", "a.b.com", "", None, "allow"),
    ("http://a.b.com/", "a.b.com", "/", "com/", "allow"),
    ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://x.net/ES/1", "x.net", "/ES/1", None, "allow"),
    ("http://notcom/", "notcom", "/", None, "allow"),
    ("http://x.telecom/en/", "x.telecom", "/en/", None, "allow"),
    ("http://www.cheap-pills.org/a", "www.cheap-pills.org", "/a", None, "block"),
    ("http://www.cheap-pills.com/a", "www.cheap-pills.com", "/a", "com/", "allow"),
    ("no scheme.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("a://b://c.com/", "b:", "//c.com/", None, "allow"),
    ("http://x.com/" + "a" * 100_000, "x.com", "/" + "a" * 100_000, "com/", "allow"),
]


def test_verdicts_of_single_urls(spark):
    urls = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "x", "y")],
                                 "page_id bigint, url string, rule string, host string")
    got = sorted(url_verdicts(urls, SITE_RULES, PATTERN_RULES).collect())
    assert [g["page_id"] for g in got] == [0, *range(len(CASES))]
    for g in got:
        assert (g["host"], g["path"], g["rule"], g["verdict"]) == CASES[g["page_id"]][1:], CASES[g["page_id"]][0][:50]


def test_empty_table_and_no_rules(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert url_verdicts(urls.limit(0), SITE_RULES, PATTERN_RULES).count() == 0
    assert [r["verdict"] for r in url_verdicts(urls, [], []).collect()] == ["allow"]


@pytest.mark.parametrize("rule, tokens", [("example.com/en/", ["com", "en", "example"]), ("*-pills.*", ["pills"]), ("net/es", ["net"]),
                                          ("*casino*/*", []), ("a.b/", ["a", "b"])])
def test_tokens_are_whole_in_every_fitting_url(rule, tokens):
    assert rule_tokens(rule) == tokens
    assert rule_regex("a.b/").startswith("^(?:[^/]*")


def test_a_rule_without_literals_is_tried_on_every_url(spark):
    urls = spark.createDataFrame([(1, "http://mycasinos.org/x"), (2, "http://a.org/x")], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_verdicts(urls, [], [("block", "*casino*/*")]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_inner_literals_are_filed_by_four_characters(spark):
    assert rule_grams("*Casino*/*") == ["~asin", "~casi", "~sino"] and rule_grams("*ad*") == [] and literals("net/es") == ["net"]
    urls = spark.createDataFrame([(1, "http://mycasinos.org/x"), (2, "http://a.org/sino/casi"), (3, "http://\U0001f600adult-x.org/"), (4, "http://ad.org")],
                                 "page_id bigint, url string")
    rules = [("block", "*casino*/*"), ("block", "*\U0001f600adult-*"), ("block", "*d.o*")]
    got = {r["page_id"]: r["pattern"] for r in url_verdicts(urls, [], rules).collect()}
    assert got == {1: "*casino*/*", 2: None, 3: "*\U0001f600adult-*", 4: "*d.o*"}
    sites = spark.createDataFrame([(["~asin", "~casi", "~casi"],), (["~asin", "~sino"],), (["~sino", "~asin"],)], "tokens array<string>")
    filed = {r["rule"]: r["token"] for r in rule_index(spark, sites, [("pattern", *r) for r in rules]).collect()}
    assert (filed["*casino*/*"], filed["*d.o*"]) == ("~casi", "")


def test_thousands_of_rules_equal_trying_each(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcde", k=rng.randint(3, 7))) for _ in range(3_000)]
    rules = [(rng.choice(["allow", "block"]), r) for r in sorted({rng.choice(["*{}*", "*{}-*", "*-{}.*", "{}.org/", "*{}*/*"]).format(n) for n in names})]
    rules += [("block", f"site{i}.com/p{i % 7}/") for i in range(3_000)]
    urls = [f"https://{rng.choice(['', 'www.', 'a-'])}{rng.choice(names)}{rng.choice(['', 'x', '-y'])}.org/{rng.choice(names)}" for _ in range(150)]
    urls += [f"https://www.site{rng.randrange(3_000)}.com/p{rng.randrange(7)}/1" for _ in range(150)] + [None, "", "nothing"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (None, None)], "page_id bigint, url string")
    regexes = [(re.compile(rule_regex(rule)), rule) for _, rule in rules]

    def by_hand(url):
        site = url.split("://", 1)[1] if url and "://" in url else ""
        return min(((-len(rule), rule) for regex, rule in regexes if regex.match(site)), default=(0, None))[1]

    got = url_verdicts(df, [], rules).collect()
    want = [(i, by_hand(u)) for i, u in enumerate(urls)] + [(None, by_hand(urls[0])), (None, None)]
    assert sorted(((r["page_id"], r["pattern"]) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r["pattern"] is not None for r in got) > 100
