"""Run catalog queries next to their SQL and compare the results.

``python tests/compare.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from locuswise import catalog
from locuswise.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(value):
    if isinstance(value, float):
        return ("f", "nan") if math.isnan(value) else ("f", repr(value + 0.0))
    return (type(value).__name__[:1], str(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def compare(spark, con, name, sf_dir):
    start = time.time()
    frame = catalog.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    text = catalog.oracles().get(name)
    if text is None:
        return None, f"rows={len(got)} (no SQL)", took
    result = con.execute(text)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(names)}", took
    left, right = normalise(frame.columns, got), normalise(names, want)
    if left != right:
        found, expected = set(left), set(right)
        extra = [r for r in left if r not in expected][:3]
        lacking = [r for r in right if r not in found][:3]
        return False, f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lacking}", took
    return True, f"rows={len(got)}", took


if __name__ == "__main__":
    folder, chosen = sys.argv[1], sys.argv[2:]
    session = local_session(8, "compare")
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for query in chosen or catalog.queries():
        try:
            ok, note, took = compare(session, connection, query, folder)
        except Exception as error:
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {query} {took:.2f}s {note}", flush=True)
    print("failures:", bad)
