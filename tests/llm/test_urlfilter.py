import random
import re

import duckdb
import pyarrow as pa
import pytest

from rankweave.llm import urlfilter
from rankweave.llm.urlfilter import Automaton, GlobRule, HostRule


def brute(glob: str, data: bytes) -> bool:
    """Recursion over bytes and glob."""
    pieces, known = re.findall(rb"\*\*|.", glob.encode(), re.DOTALL), {}

    def fit(i: int, j: int) -> bool:
        if (i, j) not in known:
            if i == len(pieces):
                known[i, j] = j == len(data)
            elif pieces[i] in (b"*", b"**"):
                known[i, j] = fit(i + 1, j) or (j < len(data) and (pieces[i] == b"**" or data[j : j + 1] != b"/") and fit(i, j + 1))
            else:
                known[i, j] = j < len(data) and (data[j : j + 1] == pieces[i] or (pieces[i] == b"?" and data[j : j + 1] != b"/")) and fit(i + 1, j + 1)
        return known[i, j]

    return fit(0, 0)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_fits_what_recursion_fits(seed):
    rng = random.Random(seed)
    globs = ["".join(rng.choices(["a", "b", "/", "?", "*", "**", "é"], k=rng.randint(0, 9))) for _ in range(70)]
    urls = ["".join(rng.choices("ab/é", k=rng.randint(0, 12))) for _ in range(200)] + ["", "a" * 90]
    fits = Automaton(globs).fits(pa.array(urls, pa.string()))
    assert Automaton(globs).words > 1
    for row, url in zip(fits, urls, strict=True):
        assert row.tolist() == [brute(g, url.encode()) for g in globs]


def test_globs_that_cross_words():
    globs = ["x" * 50, "*" + "ab" * 60, "**" + "c" * 64 + "?", "a" * 63, "b" * 64]
    urls = ["x" * 50, "zz" + "ab" * 60, "/" + "c" * 65, "a" * 63, "a" * 64, "b" * 64, "c" * 64]
    fits = Automaton(globs).fits(pa.array(urls))
    assert fits.tolist() == [[brute(g, u.encode()) for g in globs] for u in urls]


def test_slices_and_batches(monkeypatch):
    monkeypatch.setattr(urlfilter, "BATCH", 40)
    urls = [f"h{i}/" + "p" * (i % 30) for i in range(100)]
    fits = Automaton(["h?/**", "*/ppp"]).fits(pa.array(urls).slice(10, 50))
    assert fits.tolist() == [[brute(g, u.encode()) for g in ["h?/**", "*/ppp"]] for u in urls[10:60]]


ROWS = [
    (1, "http://WWW.Example.com/en/1?x=1", "h"),
    (2, "https://example.com/en/", None),
    (3, "https://a.b.example.com/en/9#t", "h"),
    (4, "https://example.com", "h"),
    (5, "https://notexample.com/en/", "h"),
    (6, "http://x.net/fr/1", "h"),
    (7, "http://x.net/de/login/1", "h"),
    (8, "http://ads-1.example.org/de/", "h"),
    (9, "http://m.ads-1.example.org/de/", "h"),
    (10, "http://o.org/x.example.com/en/", "h"),
    (11, None, "h"),
    (12, "no scheme", "h"),
    (13, "http://", "h"),
    (14, "x://a://b.com/q", "h"),
    (15, "http://o.org/" + "a/" * 40_000 + "f.exe", "h"),
    (16, "http://o.org?u=http://x.com/", "h"),
    (17, "http://É.com/ü\n/robots.txt", "h"),
    (1, "http://WWW.Example.com/en/1?x=1", "h"),
    (None, "http://x.net/es/", "h"),
]
SCHEMA = "page_id long, url string, rule string"


def plain(url):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    rules = [r for r in urlfilter.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if rules:
        best = max(rules, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    verdict = "allow"
    for rule in urlfilter.GLOB_RULES:
        pattern = "".join({"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", rule.glob))
        if re.fullmatch(pattern, host + path):
            verdict = rule.verdict
    return host, path, None, verdict


def test_judges_every_row(spark):
    got = urlfilter.judge(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain(u)) for i, u, _ in ROWS), key=str)


def test_sql_agrees(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(urlfilter.ORACLE_SQL).fetchall()
    got = urlfilter.op12_url_filter(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_other_rules_and_none(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = urlfilter.judge(pages, [], [], "block").collect()
    assert {(r.rule, r.verdict) for r in got} == {(None, "block")}
    only = urlfilter.judge(pages, [HostRule("org", "/", "allow")], [GlobRule("**", "block")]).collect()
    assert {r.page_id for r in only if r.verdict == "allow"} == {8, 9, 10, 15}


def test_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], SCHEMA)).collect() == []
