"""URL filters against a plain version that tries every rule."""

import random
import re

from stateglass.llm.urls import Rule, host_and_path, host_word_rule, judge_urls, site_rule


def plain(url, rules, fallback):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:])[0]
    own = []
    for verdict, name in rules:
        site, _, start = name.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start):
            own.append((len(name), verdict == "block", name, verdict))
    if own:
        return (host, path, *max(own)[2:])
    word = any(re.search(rf"(^|[^a-z0-9]){w}($|[^a-z0-9])", host) for w in fallback)
    return host, path, None, "block" if word else "allow"


def test_matches_plain_version(spark):
    rng = random.Random(6)
    names = ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr", "a-b.org/x/y", "org/"]
    rules = [(rng.choice(["allow", "block"]), n) for n in names]
    hosts = ["example.com", "WWW.Example.com", "m.www.example.com", "example.net", "xcom", "com", "a-b.org", "bad.org", "notbad.io", "bad-1.io", "é.net"]
    paths = ["", "/", "/en/", "/en", "/EN/", "/es/1", "/fr", "/french", "/x/y/z", "/x/yz", "?a=/en/", "#x", "/en/?q", ":80/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://", "http://", "x://a://b/en/", "http://user@example.com/en/", "http://a\nb.com/x\ny", "http://com/" + "y" * 100_000]
    rows = [(i, u, "x") for i, u in enumerate([*urls, *urls[:5]])]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judge_urls(frame, [site_rule(v, n) for v, n in rules], [host_word_rule("block", "bad")])
    for row in got.collect():
        assert tuple(row.judged) == plain(row.url, rules, ["bad"]), row.url
    assert got.count() == len(rows)
    assert judge_urls(frame.limit(0), []).count() == 0


def test_rules_without_literals_and_ties(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = [Rule("xx", "allow", r"a\.b", ("a", "b")), Rule("yy", "block", "c", ()), Rule("z", "allow", "nothing", ())]
    assert tuple(judge_urls(frame, rules).first().judged) == ("a.b", "/c", "yy", "block")
    assert host_and_path("HTTP://A.B?x") == ("a.b", "")
