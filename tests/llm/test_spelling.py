import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import awkward, documents
from locuswise.llm import spelling
from locuswise.llm.common import table


def counted(rows, damaged=None, length=6, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damaged and h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected(counts, times=5):
    near = {w: [v for v in counts if v != w and one_apart(v, w)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= times * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


WORDS = {
    "houseé": 900, "housé": 7, "houuseé": 8, "houseb": 6, "housec": 90, "housed": 90, "houses": 2000, "housess": 300, "housesss": 20,
    "housessss": 5, "aaaaaaa": 50, "aaaaaaaa": 5, "aaaaaaaaa": 400, "abababab": 10, "abababa": 11, "bababab": 60, "xhouses": 400, "xxhouses": 79,
    "lonely": 5, "lonel": 500, "ÿþýüûú": 5, "ÿþýüûÀ": 25, "housesé": 12, "hoûses": 3,
}


def test_planted_words(spark):
    counts = {w: n for w, n in WORDS.items()}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    got = rows_of(spelling.variant_groups(df))
    assert got == expected(counts)
    assert any(r[1] and r[1] != r[2] for r in got)  # a form has a form


@pytest.mark.parametrize("seed", range(3))
def test_random_words_over_few_letters(spark, seed):
    import random

    rng = random.Random(seed)
    counts = {"".join(rng.choices("abé", k=rng.randint(1, 7))): rng.choice([5, 6, 30, 31, 150, 800]) for _ in range(300)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(1 + 5 * seed)
    assert rows_of(spelling.variant_groups(df)) == expected(counts)


def test_trie_numbers_name_beginnings(spark):
    words = [w for w in WORDS] + ["houses" + "x" * k for k in range(60)]
    df = spark.createDataFrame([(w, w) for w in words], "key string, word string").repartition(9)
    saved = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the few words meet in one partition
    try:
        rows = spelling.trie_nodes(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", saved)
    numbers = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for depth, node in enumerate(r.nodes):
            assert numbers.setdefault(r.word[:depth], node) == node
    assert len(set(numbers.values())) == len(numbers)
    assert [r.word for r in sorted(rows, key=lambda r: r["rank"])] == sorted(words)


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, tmp_path, clashing):
    long = "q" * 20_000
    rows = [*awkward(), *[(i, f"Wonderful wonderful×wonderful {long} wondrful{i % 2 or ''} WONDERFULÀ") for i in range(10, 16)], (None, "wonderful lonely\n" * 6)]
    got = rows_of(spelling.spelling_variants(documents(spark, tmp_path, rows, clashing)))
    assert got == expected(counted(rows)) and len(got) >= 5


def test_damage(spark, tmp_path):
    rows = [(i, "alphabet betaword gammaword deltaword epsilonword zetawords " * 3) for i in range(60)] + [(None, "alphabet " * 5)]
    got = rows_of(spelling.spelling_variants(documents(spark, tmp_path, rows), damaged=7))
    assert got == expected(counted(rows, damaged=7))
    assert any(r[1] for r in got)


def test_counts_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"word{chr(97 + j % 26)}{chr(97 + i % 3)}letters" for j in range(26))) for i in range(30)]
    frame = documents(spark, tmp_path, rows)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"doc_id": d, "text": t}]) for d, t in rows]
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    given = list(spelling._counted(6, None)(iter(batches)))
    assert len(given) > 10
    total = Counter()
    for b in given:
        for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
            total[w] += n
    assert {w: n for w, n in total.items() if n >= 5} == {r.word: r.n for r in spelling.word_counts(frame).collect()} == counted(rows)


def test_empty_table(spark, tmp_path):
    assert spelling.spelling_variants(documents(spark, tmp_path, [])).count() == 0


def test_query_equals_its_sql_and_brute_force(spark, small):
    got = rows_of(spelling.query(spark, small))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert got == sorted(duckdb.sql(spelling.SQL).fetchall())
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", F.col("text")).collect()]
    assert got == expected(counted(rows, damaged=199))
