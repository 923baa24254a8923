import fnmatch
import random
import re

import pytest

from gonggo.llm.url_rules import ALLOW, BLOCK, Automaton, Rule, RuleSet, judged


def test_query(against_sql):
    rows = against_sql("op5_url_rules", "/root/testdata/sf0.01")
    assert set(rows.rule.dropna()) >= {"org/", "example.org/es/"}
    assert set(rows[rows.rule.isna()].verdict) == {"allow", "block"}


def test_automaton_against_fnmatch():
    rng = random.Random(1)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    patterns = [word("ab*?/", 9) for _ in range(60)] + ["", "*", "**", "?" * 70, "a" * 130]
    texts = [word("ab/", 12) for _ in range(300)] + ["", "a" * 130, "b" * 70]
    fits = Automaton([(p, False) for p in patterns]).matches([t.encode() for t in texts])
    want = [[re.fullmatch(fnmatch.translate(p), t) is not None for p in patterns] for t in texts]
    assert fits.tolist() == want


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for r in rules:
        rule_host, _, rest = r.target.partition("/")
        rule_path = "/" + rest if "/" in r.target else ""
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(r.target) > len(best.target):
                best = r
    return host, path, best.target if best else None, best.verdict if best else None


def test_rules_against_brute_force(spark):
    rules = [Rule(ALLOW, "org/"), Rule(BLOCK, "a.org/x"), Rule(BLOCK, "a.org"), Rule(ALLOW, "b.a.org/x/y"), Rule(BLOCK, "com/de/")]
    rng = random.Random(4)
    urls = [rng.choice(["http://", "HTTPS://", "x", "", "a://b://"]) + rng.choice(["A.org", "b.a.ORG", "na.org", "org", "é.com", "u@a.org:80", ""])
            + rng.choice(["", "/", "/x", "/x/y?z", "/de/#q", "?a=/x", "#", "/X", "//x"]) for _ in range(400)]
    urls += [None, "", "://", "http://a.org/x" + "y" * 20000, "http://a.org/\n/x"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: tuple(r.judgement) for r in judged(pages, RuleSet(rules, globs=("",))).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u, rules)
        assert got[i] == (host, path, rule, verdict or (BLOCK if not host + path else ALLOW)), u


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a/"), (1, "http://a/"), (None, None)], "page_id long, url string")
    rows = judged(pages, RuleSet([], globs=(), otherwise=BLOCK)).collect()
    assert [r.judgement.verdict for r in rows] == [BLOCK] * 3
    assert judged(pages.limit(0), RuleSet([])).count() == 0
    with pytest.raises(ValueError):
        RuleSet([Rule(ALLOW, "*.org")])
