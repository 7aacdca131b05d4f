import hashlib
import zlib

import duckdb
import pytest

from helpers import awkward, documents, stored
from locuswise.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(digests, arity):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def siblings(levels, place, arity):
    """Per level: the digests before and after the node in its run."""
    for level in levels[:-1]:
        first = place - place % arity
        yield level[first:place], level[place + 1 : first + arity]
        place //= arity


def expected(rows, arity=8):
    trees = {}
    for r in rows:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text) if changed else r.text
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id, leaf(r, r.text), leaf(r, text)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for name in names:
        trees[name].sort()
        made[name] = levels_of([x[2] for x in trees[name]], arity)
    top = levels_of([made[name][-1][0] for name in names], arity)
    out = []
    for k, name in enumerate(names):
        for place, (_, doc_id, own, claim) in enumerate(trees[name]):
            path = [*siblings(made[name], place, arity), *siblings(top, k, arity)]
            root = claim
            for before, after in path:
                root = H(*before, root, *after)
            proof = H(*(x for before, after in path for x in (*before, *after)))
            out.append((doc_id, own, made[name][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def docs_frame(spark, tmp_path, rows):
    return stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), tmp_path)


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, tmp_path, clashing):
    docs = documents(spark, tmp_path, awkward(), clashing)
    assert rows_of(merkle.verified_manifest(docs)) == expected(docs.collect())


@pytest.mark.parametrize("n", [1, 8, 9, 65, 520])
def test_every_shape_of_tree(spark, tmp_path, n):
    langs = ["en", None, "", "zz", "é", "=", *[f"l{i}" for i in range(9)]]
    rows = [(i * 7 - 20, f"Text {i} Words", "en", "s", i) for i in range(n)]
    rows += [(1000 + i, None if i % 5 == 0 else f"Tä {i}", lang, None, None) for i, lang in enumerate(langs * 2) if n != 1]
    docs = docs_frame(spark, tmp_path, rows)
    got = rows_of(merkle.verified_manifest(docs))
    assert got == expected(docs.collect())
    assert {r[-1] for r in got} <= {True, False}


@pytest.mark.parametrize("arity", [2, 3])
def test_other_arities(spark, tmp_path, arity):
    rows = [(i, f"t{i}", "abc"[i % 3], "s", i) for i in range(40)]
    docs = docs_frame(spark, tmp_path, rows)
    leaves = docs.select(
        merkle.tree_name(docs.lang).alias("tree"), "doc_id", merkle.row_digest(*(docs[c] for c in merkle.FIELDS)).alias("digest")
    )
    made = merkle.manifest(leaves, arity)
    named = [merkle._hex(made[c]) for c in ("digest", "subroot", "root")]
    got = {r[0]: tuple(r) for r in made.select("doc_id", *named, merkle.proof(made.path), merkle.folded(made.digest, made.path)).collect()}
    for row in expected(docs.collect(), arity):
        assert got[row[0]][:5] == row[:5] and got[row[0]][5] == row[3]


def test_a_change_of_any_field_is_found(spark, tmp_path):
    rows = [(i, "abc", "en", "s", 3) for i in range(20)]
    root = merkle.verified_manifest(docs_frame(spark, tmp_path, rows)).first().root
    for changed in ((0, "abd", "en", "s", 3), (0, "abc", "de", "s", 3), (0, "abc", "en", None, 3), (0, "abc", "en", "s", 4), (-1, "abc", "en", "s", 3)):
        other = merkle.verified_manifest(docs_frame(spark, tmp_path, [changed, *rows[1:]])).first().root
        assert other != root


def test_empty_table(spark, tmp_path):
    assert merkle.verified_manifest(documents(spark, tmp_path, [])).count() == 0


def test_query_equals_its_sql(spark, small):
    got = {tuple(r) for r in merkle.query(spark, small).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert got == set(duckdb.sql(merkle.SQL).fetchall())
    assert {r[-1] for r in got} == {True, False}
