import numpy as np
import pytest

from helpers import CLASHING, stored
from locuswise.llm import urls
from pyspark.sql import functions as F


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[k:]
    cut = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), tail[:cut]


def rule_of(host, path):
    fits = []
    for rule, verdict in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((-len(rule), rule, verdict))
    return min(fits)[1:] if fits else None


CASES = [
    None, "", "no scheme", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "http://example.net/en/1", "http://m.example.net/en", "http://xnet/a",
    "http://a.org/fr/", "http://a.org/fr", "http://org/fr/x://b", "https://www.example.com/de/#top", "http://É.net/Ä", "http://a.net?q", "x://y://z/", "http://casino-win.example.com/en/4",
]


@pytest.mark.parametrize("clashing", [False, True])
def test_hosts_paths_and_rules(spark, tmp_path, clashing):
    df = spark.createDataFrame([(i, u, "x" * 10) for i, u in enumerate(CASES * 2)], "page_id long, url string, html string")
    if clashing:
        df = df.withColumns({c: F.lit("mine") for c in [*CLASHING, "host", "path", "rule", "verdict"]})
    got = urls.judged(stored(df, tmp_path)).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        url = CASES[r.page_id % len(CASES)]
        assert (r.host, r.path) == plain(url)
        want = rule_of(r.host, r.path)
        assert r.rule == (want[0] if want else None)
        if want:
            assert r.verdict == want[1]


def test_model_on_names_it_has_not_seen():
    rows = urls.labelled_urls()
    fitted = urls.train(rows[: len(rows) * 3 // 4])
    right = [
        (fitted.probability(np.array([fitted.weights[at] @ value + fitted.bias]))[0] >= urls.THRESHOLD) == bool(y)
        for host, path, y in rows[len(rows) * 3 // 4 :]
        for at, value in [urls.grams(host, path)]
    ]
    assert np.mean(right) > 0.9


def test_empty_table_and_very_long_url(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.com/" + "x" * 300_000)], "page_id long, url string")
    assert len(urls.judged(stored(df, tmp_path)).first().path) == 300_001
    assert urls.judged(stored(df.limit(0), tmp_path)).count() == 0
