import random

import numpy as np
import pytest

from helpers import awkward, documents
from locuswise.llm import exact_dedup, graph, near_dedup
from locuswise.llm.common import ROW, table, with_row_key
from locuswise.llm.graph import component_names


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected(rows):
    """doc_id -> (n_shingles, smallest doc_id reachable), by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(s), least.get(find(k)) if s else d) for k, (d, s) in enumerate(sets)), key=str)


def found(docs):
    rows = near_dedup.near_groups(with_row_key(docs)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, tmp_path, clashing):
    rows = awkward()
    assert found(documents(spark, tmp_path, rows, clashing)) == expected(rows)


def test_near_copies_of_many_kinds(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, passage = [], rng.choices(vocabulary, k=60)
    for base in range(40):
        words = rng.choices(vocabulary, k=rng.choice((6, 20, 90, 300)))
        for copy in range(rng.choice((1, 2, 3, 12))):
            changed = [rng.choice(vocabulary) if rng.random() < 0.015 * (copy % 4) else w for w in words]
            rows.append((len(rows), " ".join(changed).upper() if copy % 2 else " ".join(changed)))
        rows.append((len(rows), " ".join(rng.choices(vocabulary, k=rng.choice((10, 40))) + passage)))
    assert found(documents(spark, tmp_path, rows)) == expected(rows)


def test_group_larger_than_a_small_region_around_one_text(spark, tmp_path):
    """Copies that are near the original only, not near each other: the pivot has to be the original."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, " ".join(words))]
    for k in range(150):
        changed = list(words)
        for i in range(10):
            changed[rng.randrange(20 + 38 * i, 38 * i + 30)] = f"new{k}x{i}"
        rows.append((k, " ".join(changed)))
    want = expected(rows)
    assert {c for *_, c in want} == {0}
    assert found(documents(spark, tmp_path, rows)) == want


def _edited(rng, words, places, tag):
    """``words`` with one word changed at each of ``places`` spots at least 20 apart."""
    out = list(words)
    for i in rng.sample(range(len(words) // 20), places):
        out[20 * i + rng.randrange(10)] = f"{tag}x{i}"
    return out


@pytest.fixture
def first_depth_only(monkeypatch):
    """Large regions aren't looked at deeper down, so that their rest has to find what the pivots leave out."""
    monkeypatch.setattr(near_dedup, "DEPTHS", near_dedup.DEPTHS[:1])


def test_texts_near_to_one_member_of_a_crowded_region_only(spark, tmp_path, first_depth_only):
    """Around a text with 150 copies lie texts that are near to one copy each, but not to the text itself."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(600)]
    copies = [_edited(rng, words, 15, f"a{k}") for k in range(150)]
    rows = [(1000 + k, " ".join(c)) for k, c in enumerate([words, *copies])]
    rows += [(k, " ".join(_edited(rng, copies[k], 14, f"b{k}"))) for k in range(60)]
    want = expected(rows)
    assert found(documents(spark, tmp_path, rows)) == want
    assert sum(c == 0 for *_, c in want) > 200


def test_pairs_among_many_texts_that_share_a_passage(spark, tmp_path, first_depth_only):
    """A passage that makes up half of 500 texts crowds the regions; the near pairs among them are found all the same."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for k in range(500):
        words = passage + [f"t{k}w{i}" for i in range(150)]
        rows.append((len(rows), " ".join(words)))
        if k % 4 == 0:
            rows.append((len(rows), " ".join(words[:160] + _edited(rng, words[160:], 6, f"c{k}"))))
            rows.append((len(rows), " ".join(_edited(rng, words, 9, f"d{k}"))))
    assert found(documents(spark, tmp_path, rows)) == expected(rows)


@pytest.mark.parametrize("block", [2, 7, 512])
def test_many_texts_alike_by_half_and_a_large_group(spark, tmp_path, first_depth_only, monkeypatch, block):
    """A large group of near copies, and around it texts alike by 50 to 75 % without a link: postings hold many of both."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(_edited(rng, words, k % 6, f"a{k}"))) for k in range(120)]
    rows += [(200 + k, " ".join(_edited(rng, words, 19, f"b{k}")[: 300 + k % 90])) for k in range(60)]
    rows += [(300 + k, " ".join(_edited(rng, _edited(rng, words, 12, f"c{k % 9}"), 4, f"d{k}"))) for k in range(45)]
    want = expected(rows)
    assert 10 < len({c for *_, c in want}) < 120
    assert found(documents(spark, tmp_path, rows)) == want


def test_block_links_join_what_is_linked_and_no_more():
    rng = random.Random(2)
    for _ in range(40):
        pool = [frozenset(rng.sample(range(60), 40)) for _ in range(4)]
        sets = [frozenset(x for x in rng.choice(pool) if rng.random() < 0.93) for _ in range(25)]
        component = np.array([rng.randrange(12) for _ in sets])
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        links = near_dedup.block_links(np.arange(25), component, arrays)
        assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links) and len(links) < 25
        true = [(a, b) for a in range(25) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        same = [(a, b) for a in range(25) for b in range(a) if component[a] == component[b]]

        def groups(pairs):
            label = list(range(25))
            for a, b in pairs:
                label = [label[b] if x == label[a] else x for x in label]
            return {frozenset(i for i in range(25) if label[i] == x) for x in label}

        assert groups(same + links) == groups(same + true)


def test_stage_keeps_one_of_each_group_and_all_blank_rows(spark, tmp_path):
    docs = documents(spark, tmp_path, awkward(), clashing=True)
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "6", "7", "None"]
    assert {r[ROW] for r in rows} == {"mine"}


def test_empty_table(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert found(docs) == [] and near_dedup.drop_near_copies(docs).count() == 0


def test_whole_table_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert found(table(spark, small, "documents")) == expected(rows)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(100)]
    links = spark.createDataFrame([*chain, *star, (5000, 5000), (7, 3)], "a long, b long")
    names = {r.node: r.component for r in component_names(links).collect()}
    assert len({names[i] for i in range(201)}) == 1 and len({names[i] for i in range(1000, 1101)}) == 1
    assert names[0] != names[1000] and 5000 not in names
    assert component_names(links.filter("a = b")).count() == 0


@pytest.mark.parametrize("module, stage", [(near_dedup, near_dedup.drop_near_copies), (exact_dedup, exact_dedup.drop_exact_copies)])
def test_stages_keep_their_rows_when_files_are_cut_anew(spark, tmp_path, recut, module, stage):
    recut(module)
    docs = _in_files(spark, tmp_path)
    assert sorted(r.doc_id for r in stage(docs).collect()) == list(range(0, 80, 2))


def test_groups_when_files_are_cut_anew(spark, tmp_path, recut):
    recut(near_dedup)
    docs = _in_files(spark, tmp_path, " more")
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def _in_files(spark, tmp_path, tail=""):
    """80 documents in eight files; each odd one copies the one before, which lies in another file, and adds ``tail``."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(2000)], k=40)) for _ in range(40)]
    docs = documents(spark, tmp_path, [(d, texts[d // 2] + tail * (d % 2)) for d in range(80)])
    docs.repartitionByRange(8, (docs.doc_id * 7) % 80).write.parquet(f"{tmp_path}/files")
    return spark.read.parquet(f"{tmp_path}/files")


@pytest.fixture
def recut(spark, monkeypatch):
    """After the first table that a module stores, files are cut another way, as when executors come or go."""
    key = "spark.sql.files.maxPartitionBytes"

    def start(module):
        spark.conf.set(key, "2k")
        plain = module.settled

        def settled(*args):
            out = plain(*args)
            spark.conf.set(key, "128m")
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            return out

        monkeypatch.setattr(module, "settled", settled)

    yield start
    spark.conf.unset(key)
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_bits_never_rule_out_a_link():
    r = np.random.default_rng(8)
    for n in (1, 3, 20, 300, 4000):
        for share in (0.0, 0.3, 0.5, 0.74, 0.75, 0.76, 0.9, 1.0):
            for m in (n, -(-3 * n // 4), n + n // 4):
                both = min(round(share * (n + m) / (1 + share)), n, m)
                every = np.unique(r.integers(0, 2**63, 2 * (n + m) + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                drawn = r.permutation(every)
                mine, other = drawn[:n], np.concatenate([drawn[:both], drawn[n : n + m - both]])
                most = near_dedup.most_common(n, near_dedup.shingle_bits(mine), m, near_dedup.shingle_bits(other))
                assert both <= most <= min(n, m)


def test_pairs_that_are_alike_by_half_need_no_texts(spark):
    words = [f"w{i}" for i in range(400)]
    half = [words[:300] + [f"{k}x{i}" for i in range(100)] for k in range(6)]
    near = [words[:390] + [f"{k}y{i}" for i in range(10)] for k in range(3)]
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(half + near)], "node long, text string")
    pairs = spark.createDataFrame([(i, j) for j in range(9) for i in range(j)], "a long, b long")
    left = {(p.a, p.b) for p in near_dedup.possible_pairs(pairs, texts).collect()}
    assert left == {(6, 7), (6, 8), (7, 8)}
    assert {(p.a, p.b) for p in near_dedup.confirmed_links(pairs, texts).collect()} == left


@pytest.mark.parametrize("links_at_once", [3, 1 << 16])
def test_components_joined_in_tasks_and_in_rounds(spark, monkeypatch, links_at_once):
    monkeypatch.setattr(graph, "LINKS", links_at_once)
    rng = random.Random(6)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    label = list(range(120))
    for a, b in pairs:
        label = [label[b] if x == label[a] else x for x in label]
    rows = graph.component_names(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    names = {r.node: r.component for r in rows}
    assert len(rows) == len(names) and set(names) == {x for a, b in pairs if a != b for x in (a, b)}
    assert all((names[x] == names[y]) == (label[x] == label[y]) for x in names for y in names)


def test_steps_do_not_grow_with_the_depth_of_crowded_regions(spark, tmp_path, monkeypatch):
    """300 near copies crowd every depth; all depths are counted in one step, and the links need one job, not a round each."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(_edited(rng, words, 1, f"a{k}"))) for k in range(300)]
    steps, plain = [], near_dedup.settled

    def settled(df, name="table"):
        steps.append(name)
        return plain(df, name)

    monkeypatch.setattr(near_dedup, "settled", settled)
    monkeypatch.setattr(graph, "settled", settled)
    assert found(documents(spark, tmp_path, rows)) == sorted(((k, 896, 0) for k in range(300)), key=str)
    assert len(steps) < 40
