import random
import re

import pytest

from pluvia.llm import urlfilter as U


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        wide = glob[i : i + 2] == "**"
        out += "(?s:.*)" if wide else {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i])
        i += 2 if wide else 1
    return re.compile(out)


def test_automaton():
    random.seed(2)
    for _ in range(100):
        globs = ["".join(random.choices("ab./*?", k=random.randint(0, 7))) for _ in range(random.randint(1, 40))]
        urls = ["".join(random.choices("ab./", k=random.randint(0, 9))) for _ in range(20)]
        fits = U.Automaton(globs).fits([u.encode() for u in urls])
        assert fits.tolist() == [[bool(as_regex(g).fullmatch(u)) for g in globs] for u in urls]


CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://x.net/fr/1#t", "x.net", "/fr/1", "net/fr/", "block"),
    ("https://evil.org/a.net/fr/1", "evil.org", "/a.net/fr/1", None, "allow"),
    ("https://a.com", "a.com", "", None, "allow"),
    ("https://a.com?q=/en/", "a.com", "", None, "allow"),
    ("x://spam-farm.org/a", "spam-farm.org", "/a", None, "block"),
    ("https://é.com/ü" + "x" * 50000, "é.com", "/ü" + "x" * 50000, "com/", "allow"),
    ("://", "", "", None, "allow"),
]


def test_cases(spark):
    rows = [(i, c[0], "html", "rule") for i, c in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = sorted(U.filter_urls(pages).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [c[1:] for c in CASES]
    twice = U.filter_urls(pages.unionByName(pages)).count()
    assert twice == 2 * len(CASES) and U.filter_urls(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        U.Rule.site("block", "a*.com", "/")
