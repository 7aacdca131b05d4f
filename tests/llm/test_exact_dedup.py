import hashlib

import duckdb
import pytest

from helpers import awkward, documents
from locuswise.llm import exact_dedup
from locuswise.llm.common import ROW, with_row_key


def _bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")


def _expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(_bare(text), []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for doc_id, text, *_ in rows:
        group = groups[_bare(text)]
        out.append((doc_id, min(group)[2], len(group), hashlib.sha256(_bare(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_groups_of_awkward_rows(spark, tmp_path, clashing):
    rows = awkward()
    got = exact_dedup.exact_groups(with_row_key(documents(spark, tmp_path, rows, clashing))).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == _expected(rows)
    assert sum(r.kept for r in got) == len({_bare(t) for _, t in rows})


def test_kept_rows_keep_their_columns(spark, tmp_path):
    docs = documents(spark, tmp_path, awkward(), clashing=True)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({_bare(t) for _, t in awkward()})
    assert {r["kept"] for r in rows} == {"mine"} and {r[ROW] for r in rows} == {"mine"}


def test_large_group_and_every_number_of_runs(spark, tmp_path):
    rows = [(i, "same text" + " " * (i % 7)) for i in range(500)] + [(1000 + i, f"text {i}") for i in range(50)]
    keyed = exact_dedup.digests(with_row_key(documents(spark, tmp_path, rows)))
    answers = [
        sorted((r.text_sha256, r.place.doc_id, r.group_size) for r in exact_dedup.merge_runs(keyed, runs, fan).collect())
        for runs, fan in ((1, 2), (3, 2), (64, 4))
    ]
    assert answers[0] == answers[1] == answers[2]
    assert (6, 500) in [(p, n) for _, p, n in answers[0]]


def test_empty_table(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert exact_dedup.exact_groups(with_row_key(docs)).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == 0


def test_query_equals_its_sql(spark, small):
    got = {tuple(r) for r in exact_dedup.query(spark, small).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert got == set(duckdb.sql(exact_dedup.SQL).fetchall())


def test_no_python_in_the_plan(spark, small):
    plan = exact_dedup.query(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
