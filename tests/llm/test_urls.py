"""The URL automaton against plain string functions, regular expressions and DuckDB."""

import re

from hypothesis import given, settings, strategies as st

from tests.compare import duckdb_over, duckdb_rows, spark_rows
from tests.llm.fixtures import FOLDER
from tracemill.llm import urls
from tracemill.llm.queries import ORACLE_SQL, op5_url_automaton


def brute(url):
    host, path = urls.split_url(url)
    fitting = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fitting, key=lambda r: len(r.name), default=None)
    return host, path, rule.name if rule else None, rule.verdict if rule else "allow"


def judge(found):
    return urls._judged(found, urls.RULES, urls.Automaton([r.symbols() for r in urls.RULES]), "allow")


PARTS = ["http", "://", "/", "?", "#", ".", "net", "NET", "example", "com", "org", "/en/", "/de/", "/fr/", "x", "é", ":80", "@"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), min_size=1, max_size=6))
def test_rules(found):
    assert judge(found) == [brute(u) for u in found]


def test_named_cases():
    cases = {
        "http://a.net": None, "http://a.net/": "net/", "HTTPS://A.NET/x?y": "net/", "http://xnet/": None, "http://net/": "net/",
        "http://b.example.net/en/": "example.net/en/", "http://example.net/en": "net/", "http://example.com/de/" + "x" * 500: "example.com/de/",
        "http://com/x.net/": None, "a.net/": None, "": None, None: None, "://a.org/fr/": "org/fr/",
    }
    assert [r[2] for r in judge(list(cases))] == list(cases.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=70), min_size=1, max_size=5), st.lists(st.text("ab/", max_size=70), min_size=1, max_size=5))
def test_globs_over_several_words(globs, texts):
    """Rules of up to 70 states lie across words of 64 bits."""
    def pattern(glob):
        return re.sub(r"\*\*|\*|\?|.", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0], re.escape(m[0])), glob)

    found = urls.Automaton([urls.glob_symbols(g) for g in globs]).matches([t.encode() for t in texts])
    assert found.tolist() == [[bool(re.fullmatch(pattern(g), t)) for g in globs] for t in texts]


def test_quoted_wildcards():
    found = urls.Automaton([urls.glob_symbols("a\\*b")]).matches([b"a*b", b"axb"])
    assert found.tolist() == [[True], [False]]


def test_equals_duckdb(spark):
    assert spark_rows(op5_url_automaton(spark, FOLDER)) == duckdb_rows(duckdb_over(FOLDER), ORACLE_SQL["op5_url_automaton"])


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (None, "http://a.net/", None), (1, "", "y"), (1, "", "y"), (2, "http://" + "a" * 50_000 + ".net/", "")], "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "'clash' AS verdict")
    found = urls.filter_urls(pages).collect()
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in found) == [(0, "net/", "block"), (1, "", "allow"), (1, "", "allow"), (1, "", "allow"), (2, "net/", "block")]
    assert urls.filter_urls(pages.limit(0)).count() == 0
