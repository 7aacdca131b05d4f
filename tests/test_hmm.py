"""Scoring, decoding and training against plain NumPy and path enumeration."""

import itertools

import numpy as np
import pytest

from locuswise.functions import kernels
from locuswise.operators import decoding, holes, joint, scoring
from locuswise.plans import optimise

rng = np.random.default_rng(11)
S = 3


def random_model(seed=1, states=S):
    r = np.random.default_rng(seed)
    trans = r.dirichlet(np.ones(states) * 2, size=states)
    het = r.uniform(0.05, 0.6, size=states)
    return trans, np.column_stack([1 - het, het, np.ones(states)])


def forward(obs, trans, emis, start=None, opens=()):
    alpha = (np.full(len(trans), 1 / len(trans)) if start is None else start) * emis[:, obs[0]]
    ll = np.log(alpha.sum())
    alphas = [alpha / alpha.sum()]
    for t, o in enumerate(obs[1:], 1):
        alpha = (alphas[-1] if t in opens else alphas[-1] @ trans) * emis[:, o]
        ll += np.log(alpha.sum())
        alphas.append(alpha / alpha.sum())
    return ll, np.array(alphas)


def full_posterior(obs, trans, emis):
    _, alphas = forward(obs, trans, emis)
    beta = np.ones(len(trans))
    out, counts = [alphas[-1] * beta], np.zeros_like(trans)
    for t in range(len(obs) - 2, -1, -1):
        pair = alphas[t][:, None] * trans * (emis[:, obs[t + 1]] * beta)[None]
        counts += pair / pair.sum()
        beta = trans @ (emis[:, obs[t + 1]] * beta)
        beta /= beta.sum()
        joint_p = alphas[t] * beta
        out.append(joint_p / joint_p.sum())
    return np.array(out[::-1]), counts


def sequences():
    r = np.random.default_rng(4)
    return {(d, b): r.choice([0, 0, 0, 1, 2], size=n) for (d, b), n in {(1, 0): 61, (2, 0): 61, (1, 1): 23}.items()}


@pytest.fixture(scope="module")
def data(spark):
    rows = []
    for (d, b), obs in sequences().items():
        at = 0
        for state, group in itertools.groupby(obs):
            n = len(list(group))
            rows.append((d, b, at + 1, at + n, int(state)))
            at += n
    runs = spark.createDataFrame(rows, "diploid long, block_id int, start_pos long, end_pos long, state int")
    blocks = spark.createDataFrame(
        [(0, "chr1", 1, 61, 1, 61), (1, "chr2", 1, 23, 1, 23)],
        "block_id int, chrom string, start long, end long, lower_cut long, upper_cut long",
    )
    return runs.cache(), blocks


def models_table(spark, seeds):
    rows = []
    for seed in seeds:
        trans, emis = random_model(seed)
        rows.append((seed, trans.ravel().tolist(), emis.ravel().tolist()))
    return spark.createDataFrame(rows, "candidate_id long, trans array<double>, emis array<double>")


@pytest.mark.parametrize("size, fan_in", [(1000, 16), (10, 16), (3, 2)])
def test_loglik_is_independent_of_fragments(spark, data, monkeypatch, size, fan_in):
    monkeypatch.setattr(scoring, "FAN_IN", fan_in)
    monkeypatch.setattr(scoring, "MODELS_PER_BATCH", 2)
    got = scoring.forward_loglik(*data, models_table(spark, [1, 2, 5]), size).collect()
    assert len(got) == 9
    for r in got:
        trans, emis = random_model(r.candidate_id)
        want, _ = forward(sequences()[r.diploid, r.block_id], trans, emis)
        assert r.loglik == pytest.approx(want, abs=1e-9)


def test_loglik_by_enumeration(spark):
    trans, emis = random_model(8)
    obs = [0, 1, 2, 0, 1, 1]
    total = 0.0
    for path in itertools.product(range(S), repeat=len(obs)):
        p = emis[path[0], obs[0]] / S
        for t in range(1, len(obs)):
            p *= trans[path[t - 1], path[t]] * emis[path[t], obs[t]]
        total += p
    runs = spark.createDataFrame(
        [(1, 0, i + 1, i + 1, o) for i, o in enumerate(obs)],
        "diploid long, block_id int, start_pos long, end_pos long, state int",
    )
    blocks = spark.createDataFrame([(0, 1, 6)], "block_id int, start long, end long")
    (row,) = scoring.forward_loglik(runs, blocks, models_table(spark, [8]), 4).collect()
    assert row.loglik == pytest.approx(np.log(total), abs=1e-12)


def test_incomplete_sequences_are_refused(spark):
    from pyspark.errors import PySparkException

    blocks = spark.createDataFrame([(0, 1, 30)], "block_id int, start long, end long")
    for spans in ([(11, 30)], [(1, 10), (21, 30)]):
        runs = spark.createDataFrame(
            [(1, 0, a, b, 0) for a, b in spans],
            "diploid long, block_id int, start_pos long, end_pos long, state int",
        )
        with pytest.raises(PySparkException, match="not complete"):
            scoring.forward_loglik(runs, blocks, models_table(spark, [1]), 10).collect()


def test_many_model_batches(spark, data):
    seeds = list(range(100, 140))
    got = scoring.likelihood_sweep(models_table(spark, seeds), *data, 20).collect()
    assert sorted(r.candidate_id for r in got) == seeds
    for r in got[::7]:
        trans, emis = random_model(r.candidate_id)
        want = sum(forward(obs, trans, emis)[0] for obs in sequences().values())
        assert r.loglik == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_carry_and_posterior(spark, data, monkeypatch, fan_in):
    monkeypatch.setattr(scoring, "FAN_IN", fan_in)
    trans, emis = random_model(3)
    model, size = scoring.Model(trans, emis), 8
    starts = {(r.diploid, r.block_id, r.file_index): r.start for r in scoring.filter_carry(*data, model, size).collect()}
    posterior = {
        (r.diploid, r.block_id, r.pos): r.p for r in decoding.posterior_decode(*data, model, size).collect()
    }
    for (d, b), obs in sequences().items():
        opens = set(range(size, len(obs), size))
        _, alphas = forward(obs, trans, emis, opens=opens)
        for i, at in enumerate(range(0, len(obs), size), 1):
            start = np.full(S, 1 / S) if at == 0 else alphas[at - 1]
            assert starts[d, b, i] == pytest.approx(start, abs=1e-12)
            part = obs[at : at + size]
            _, inside = forward(part, trans, emis, start)
            beta = np.ones(S)
            for t in range(len(part) - 1, -1, -1):
                if t < len(part) - 1:
                    beta = trans @ (emis[:, part[t + 1]] * beta)
                p = inside[t] * beta
                assert posterior[d, b, at + t + 1] == pytest.approx(p / p.sum(), abs=1e-10)


@pytest.mark.parametrize("size", [1000, 8])
def test_a_null_diploid_counts_in_one_fragment_and_in_many(data, spark, size):
    runs, blocks = data
    unnamed = runs.replace(2, None, ["diploid"])
    trans, emis = random_model(3)
    model = scoring.Model(trans, emis)
    named = lambda r: 2 if r.diploid is None else r.diploid
    logs = [
        sorted((r.candidate_id, named(r), r.block_id, round(r.loglik, 9)) for r in scoring.forward_loglik(t, blocks, models_table(spark, [1]), size).collect())
        for t in (runs, unnamed)
    ]
    assert len(logs[1]) == 3 and logs[0] == logs[1]
    starts = [
        sorted((named(r), r.block_id, r.file_index, *r.start) for r in scoring.filter_carry(t, blocks, model, size).collect())
        for t in (runs, unnamed)
    ]
    assert starts[0] == starts[1]
    found = [
        sorted((named(r), r.block_id, r.pos, *r.p) for r in decoding.posterior_decode(t, blocks, model, size).collect())
        for t in (runs, unnamed)
    ]
    assert len(found[1]) == 145 and found[0] == found[1]
    proposed = [sorted((r.j, r.k, round(r.p, 9)) for r in joint.baum_welch_trans(t, blocks, model, size).collect()) for t in (runs, unnamed)]
    assert proposed[0] == proposed[1]


def test_chunked_smoothing_equals_one_pass(monkeypatch):
    trans, emis = random_model(2)
    obs = np.random.default_rng(1).choice([0, 1, 2], size=(2, 500))
    lengths = np.array([500, 333])
    emit = lambda t0, t1: emis.T[obs[:, t0:t1]]
    start = np.full((2, S), 1 / S)
    monkeypatch.setattr(kernels, "CHUNK_CELLS", 400)
    pieces = {t0: p for t0, p, _ in kernels.smooth(emit, lengths, trans, start)}
    assert len(pieces) > 5
    got = np.concatenate([pieces[t] for t in sorted(pieces)], axis=1)
    for i in range(2):
        want, _ = full_posterior(obs[i, : lengths[i]], trans, emis)
        np.testing.assert_allclose(got[i, : lengths[i]], want, atol=1e-10)


def test_expected_counts_cross_fragments(data):
    trans, emis = random_model(6)
    counts, seen = np.zeros((S, S)), np.zeros((S, 3))
    for obs in sequences().values():
        p, c = full_posterior(obs, trans, emis)
        counts += c
        for o in range(3):
            seen[:, o] += p[obs == o].sum(axis=0)
    want = counts / counts.sum(axis=1, keepdims=True)
    model = scoring.Model(trans, emis)
    got = np.zeros((S, S))
    for r in joint.baum_welch_trans(*data, model, 9).collect():
        got[r.j, r.k] = r.p
    np.testing.assert_allclose(got, want, atol=1e-9)
    rows = {(r.j, r.obs): r.p for r in joint.baum_welch_emis(*data, model, 9).collect()}
    for j in range(S):
        assert rows[j, 2] == 1.0
        assert rows[j, 1] == pytest.approx(seen[j, 1] / seen[j, :2].sum(), abs=1e-9)


def encoded(obs):
    groups = [(len(list(g)), int(k)) for k, g in itertools.groupby(obs)]
    return np.array([n for n, _ in groups]), np.array([k for _, k in groups], np.int8)


def laid_out(pieces, found, sites):
    """Posterior of each sequence from smoothed pieces."""
    out = [np.full((n, S), np.nan) for n in sites]
    for t0, posterior, _ in found:
        for piece, (row, offset, n) in enumerate(zip(pieces.row, pieces.offset, pieces.sites)):
            part = posterior[piece, : max(0, n - t0)]
            out[row][offset + t0 : offset + t0 + len(part)] = part
    return out


@pytest.mark.parametrize("least, pieces, cells", [(1, 500, 10**6), (7, 10, 600), (50, 4, 10**6), (10_000, 256, 10**6)])
def test_pieces_side_by_side_equal_one_pass(monkeypatch, least, pieces, cells):
    monkeypatch.setattr(kernels, "LEAST_PIECE", least)
    monkeypatch.setattr(kernels, "PIECES", pieces)
    monkeypatch.setattr(kernels, "CHUNK_CELLS", cells)
    trans, emis = random_model(5)
    r = np.random.default_rng(2)
    observed = [r.choice([0, 1, 2], size=n, p=[0.8, 0.15, 0.05]) for n in (1, 2, 333, 900)]
    uniform = np.full(S, 1 / S)
    powers = kernels.RunPowers(trans[None], emis[None])
    by_runs = [kernels.run_pieces(powers, i, *encoded(obs), uniform) for i, obs in enumerate(observed)]
    factors = [emis.T[obs] for obs in observed]
    by_factors = [kernels.factor_pieces(i, f, trans, uniform) for i, f in enumerate(factors)]
    for made in (by_runs, by_factors):
        cut = kernels.Pieces.joined(made)
        assert cut.sites.max() <= max(least, -(-900 // pieces))
        padded = np.ones((len(cut.sites), cut.sites.max(), S))
        for out, row, offset, n in zip(padded, cut.row, cut.offset, cut.sites):
            out[:n] = factors[row][offset : offset + n]
        emit = lambda t0, t1: padded[:, t0:t1]
        found = list(kernels.smooth(emit, cut.sites, trans, cut.start, cut.end, cut.before, cut.linked, True))
        got = laid_out(cut, found, map(len, observed))
        total = sum(counts.sum(axis=0) for *_, counts in found)
        wanted = [full_posterior(obs, trans, emis) for obs in observed]
        for mine, (want, _) in zip(got, wanted):
            np.testing.assert_allclose(mine, want, atol=1e-10)
        np.testing.assert_allclose(total, sum(c for _, c in wanted), atol=1e-8)


@pytest.mark.parametrize("step", [1, 4, 100])
def test_dense_transfer_in_pieces(monkeypatch, step):
    monkeypatch.setattr(kernels, "LEAST_PIECE", step)
    monkeypatch.setattr(kernels, "PIECES", 10**6)
    trans, _ = random_model(5)
    factors = np.random.default_rng(3).random((57, S))
    for start in (None, np.array([0.2, 0.3, 0.5])):
        want = np.eye(S) if start is None else (start * factors[0])[None]
        for f in factors[0 if start is None else 1 :]:
            want = want @ (trans * f)
        got, log = kernels.dense_transfer(factors, trans, start)
        np.testing.assert_allclose(got[0] * np.exp(log[0]), want, rtol=1e-9)


@pytest.mark.parametrize("step", [1, 3, 7, 50])
def test_runs_are_cut_at_every_step(step):
    obs = np.random.default_rng(8).choice([0, 0, 0, 1, 2], size=50)
    cut = kernels.cut_runs(*encoded(obs), step)
    assert [sum(n) for n, _ in cut] == [min(step, 50 - at) for at in range(0, 50, step)]
    assert np.concatenate([np.repeat(k, n) for n, k in cut]).tolist() == obs.tolist()


def test_a_fragment_of_the_default_size(spark):
    """One fragment of many pieces: decoding against NumPy, training against small fragments."""
    trans, emis = random_model(6)
    obs = np.random.default_rng(12).choice([0, 0, 0, 0, 0, 1, 2], size=9_000)
    lengths, symbols = encoded(obs)
    stops = np.cumsum(lengths)
    rows = [(1, 0, int(b - n + 1), int(b), int(k)) for n, b, k in zip(lengths, stops, symbols)]
    runs = spark.createDataFrame(rows, "diploid long, block_id int, start_pos long, end_pos long, state int")
    blocks = spark.createDataFrame([(0, 1, 9_000)], "block_id int, start long, end long")
    model = scoring.Model(trans, emis)
    assert kernels.piece_length(9_000) == kernels.LEAST_PIECE < 9_000
    want, _ = full_posterior(obs, trans, emis)
    got = np.array([r.p for r in decoding.posterior_decode(runs, blocks, model).orderBy("pos").collect()])
    np.testing.assert_allclose(got, want, atol=1e-9)
    for proposed, keys in ((joint.baum_welch_trans, ("j", "k")), (joint.baum_welch_emis, ("j", "obs"))):
        whole, small = (
            {tuple(r[k] for k in keys): r.p for r in proposed(runs, blocks, model, size).collect()} for size in (scoring.FRAGMENT, 700)
        )
        assert whole.keys() == small.keys() and all(whole[k] == pytest.approx(small[k], abs=1e-10) for k in whole)


def test_joint_model_over_a_fragment_of_many_pieces(spark):
    r = np.random.default_rng(10)
    factors = r.random((5_000, 2))
    trans, scales = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.5, 2.0])
    symbols = spark.createDataFrame([(1, 0, t + 1, t) for t in range(5_000)], "diploid long, block_id int, pos long, symbol int")
    table = spark.createDataFrame([(c, t, float(factors[t, c])) for c in range(2) for t in range(5_000)], "cat int, symbol int, p double")
    blocks = spark.createDataFrame([(0, 1, 5_000)], "block_id int, start long, end long")
    got = {x.pos: x.value for x in joint.em_loop(symbols, table, blocks, trans, scales, 1.0, rounds=2).collect()}
    for _ in range(2):
        _, counts = smooth_factors(factors, trans)
        trans = counts / counts.sum(axis=1, keepdims=True)
    want, _ = smooth_factors(factors, trans)
    assert [got[t + 1] for t in range(5_000)] == pytest.approx(want @ scales, abs=1e-8)


def joint_inputs(spark):
    r = np.random.default_rng(9)
    length, diploids = 40, 3
    obs = r.integers(0, 4, size=(diploids, length))
    emission = r.dirichlet(np.ones(4), size=2)
    symbols = spark.createDataFrame(
        [(d, 0, t + 1, int(obs[d, t])) for d in range(diploids) for t in range(length)],
        "diploid long, block_id int, pos long, symbol int",
    )
    table = spark.createDataFrame(
        [(c, s, float(emission[c, s])) for c in range(2) for s in range(4)], "cat int, symbol int, p double"
    )
    blocks = spark.createDataFrame([(0, 1, length)], "block_id int, start long, end long")
    factors = np.prod(emission[:, obs], axis=1).T
    return symbols, table, blocks, factors


def smooth_factors(factors, trans):
    # observation t emits factors[t], so use it as its own symbol
    return full_posterior(np.arange(len(factors)), trans, factors.T)


def test_joint_decode(spark):
    symbols, table, blocks, factors = joint_inputs(spark)
    trans, scales = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.5, 2.0])
    packed = joint.pack_factors(joint.site_factors(symbols, table, 2), blocks, 15)
    got = {r.pos: r.value for r in joint.joint_decode(packed, trans, scales, 0.1).collect()}
    for at in range(0, 40, 15):
        want, _ = smooth_factors(factors[at : at + 15], trans)
        for t, p in enumerate(want):
            assert got[at + t + 1] == pytest.approx(p @ scales * 0.1, abs=1e-10)


def test_training_equals_whole_sequence(spark):
    symbols, table, blocks, factors = joint_inputs(spark)
    trans, scales = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.5, 2.0])
    got = {
        r.pos: r.value
        for r in joint.em_loop(symbols, table, blocks, trans, scales, 1.0, size=9, rounds=4).collect()
    }
    for _ in range(4):
        _, counts = smooth_factors(factors, trans)
        trans = counts / counts.sum(axis=1, keepdims=True)
    want, _ = smooth_factors(factors, trans)
    assert [got[t + 1] for t in range(40)] == pytest.approx(want @ scales, abs=1e-8)


def test_landscape_matches_posterior(data):
    space = decoding.StateSpace(3)
    trans, emis = random_model(3)
    model = scoring.Model(trans, emis)
    values = {"rho": [0.1, 0.5, 0.9]}
    wide = {(r.diploid, r.block_id, r.pos): r for r in decoding.decode_landscape(*data, model, values, space.time_of(), 8).collect()}
    for r in decoding.posterior_decode(*data, model, 8).collect():
        row = wide[r.diploid, r.block_id, r.pos]
        assert row.rho == pytest.approx(np.dot(r.p, values["rho"]), abs=1e-12)
        assert row.k == int(np.argmax(r.p))


def test_curvature_of_a_known_surface(spark):
    best = spark.createDataFrame([("a", 1.0), ("b", -0.5)], "name string, value double")
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    precision = np.linalg.inv(cov)

    def score(candidates):
        from pyspark.sql import functions as F

        wide = optimise.pivot_params(candidates, ["a", "b"])
        a, b = F.col("a") - 1.0, F.col("b") + 0.5
        ll = -(precision[0, 0] * a * a + 2 * precision[0, 1] * a * b + precision[1, 1] * b * b) / 2
        return wide.select("candidate_id", ll.alias("loglik"))

    got = {(r.name_i, r.name_j): r.value for r in optimise.curvature_cov(best, score, 1e-3).collect()}
    assert got["a", "a"] == pytest.approx(0.04, rel=1e-6)
    assert got["a", "b"] == pytest.approx(0.01, rel=1e-6)
    ci = {r.name: r for r in optimise.curvature_ci(best, score, 1e-3).collect()}
    assert ci["a"].upper - ci["a"].value == pytest.approx(1.96 / np.sqrt(precision[0, 0]), rel=1e-6)


def test_refine_finds_the_top(spark):
    from pyspark.sql import functions as F

    def score(candidates):
        ll = -F.pow(F.col("x") - 2.3, 2) - F.pow(F.col("y") + 0.7, 2)
        return candidates.select("candidate_id", ll.alias("loglik"))

    centre, _ = optimise.refine(score, {"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, spark, rounds=14, tolerance=0)
    assert centre["x"] == pytest.approx(2.3, abs=0.05) and centre["y"] == pytest.approx(-0.7, abs=0.05)


def holed():
    """The sequences with a hole at the start, two inside and one at the end; None where nothing is known."""
    out = {}
    for key, obs in sequences().items():
        known = [int(o) for o in obs]
        for a, b in ((0, 3), (7, 8), (12, 21), (len(obs) - 2, len(obs))):
            known[a:b] = [None] * (b - a)
        out[key] = known
    # all but the ends is unknown, over more than two fragments
    out[3, 0] = [1, 0] + [None] * 57 + [1, 1]
    return out


@pytest.mark.parametrize("size", [5, 7, 90])
@pytest.mark.parametrize("way", ["drift", "restart"])
def test_likelihood_with_holes(spark, data, size, way):
    _, blocks = data
    rows = []
    for (d, b), known in holed().items():
        at = 1
        for state, group in itertools.groupby(known):
            n = len(list(group))
            if state is not None:
                rows.append((None if d == 2 else d, b, at, at + n - 1, state))
            at += n
    runs = spark.createDataFrame(rows, "diploid long, block_id int, start_pos long, end_pos long, state int")
    got = scoring.forward_loglik(runs, blocks, models_table(spark, [1, 2]), size, way).collect()
    found = {(r.candidate_id, r.diploid or 2, r.block_id): r.loglik for r in got}
    assert len(found) == len(got) == 2 * len(holed())
    for (d, b), known in holed().items():
        for seed in (1, 2):
            trans, emis = random_model(seed)
            if way == "drift":
                # a symbol that every state emits
                seen = [emis.shape[1] if o is None else o for o in known]
                want, _ = forward(seen, trans, np.column_stack([emis, np.ones(S)]))
            else:
                parts = [list(g) for unknown, g in itertools.groupby(known, lambda o: o is None) if not unknown]
                want = sum(forward(part, trans, emis)[0] for part in parts)
            assert found[seed, d, b] == pytest.approx(want, abs=1e-10)


def test_runs_within_regions(spark):
    schema = "diploid long, block_id int, start_pos long, end_pos long"
    runs = spark.createDataFrame([(1, 0, 1, 10, 0), (1, 0, 11, 30, 1), (1, 1, 1, 9, 2)], schema + ", state int")
    regions = spark.createDataFrame([(1, 0, 4, 12), (1, 0, 20, 25), (2, 0, 1, 5)], schema)
    got = {tuple(r) for r in holes.runs_within(runs, regions).select(*runs.columns).collect()}
    assert got == {(1, 0, 4, 10, 0), (1, 0, 11, 12, 1), (1, 0, 20, 25, 1)}
    with pytest.raises(ValueError):
        holes.with_holes(runs, regions, "other")
    blocks = spark.createDataFrame([(0, 1, 30)], "block_id int, start long, end long")
    assert holes.with_holes(runs.limit(0), blocks, "drift").count() == 0


def test_products_hold_few_rows_at_once():
    import pyarrow as pa

    rows, models, states = 1_000, 2, 3
    rng = np.random.default_rng(1)
    mats = [[rng.random(models * states).tolist(), rng.random(models * states**2).tolist()] for _ in range(rows)]
    logs = [[[0.0] * models] * 2 for _ in range(rows)]
    batch = pa.RecordBatch.from_pydict(
        {
            "diploid": pa.array(range(rows), pa.int64()),
            "block_id": pa.array([0] * rows, pa.int32()),
            "batch": pa.array([0] * rows, pa.int32()),
            "idx": pa.array([1] * rows, pa.int32()),
            "members": [[1, 2]] * rows,
            "mats": mats,
            "logs": logs,
        }
    )
    out = list(scoring._products([batch]))
    assert max(b.num_rows for b in out) < rows // 2
    found = [(m, log) for b in out for m, log in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
    assert len(found) == rows
    for (first, second), (m, log) in zip(mats, found):
        want = [np.array(first).reshape(models, states)[i] @ np.array(second).reshape(models, states, states)[i] for i in range(models)]
        got = np.array(m).reshape(models, states) * np.exp(log)[:, None]
        np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("cells", [1, 100, 10**6])
def test_fragments_side_by_side_equal_one_by_one(monkeypatch, cells):
    monkeypatch.setattr(kernels, "LANE_CELLS", cells)
    r = np.random.default_rng(6)
    trans, emis = (np.stack(x) for x in zip(random_model(1), random_model(2)))
    codes = [0, 1, 2, kernels.DRIFT, kernels.SKIP, kernels.OPEN, kernels.OPEN - 1]
    symbols = [r.choice(codes, size=n).astype(np.int8) for n in (1, 1, 7, 2, 7, 30)]
    lengths = [np.where(s <= kernels.OPEN, 1, r.integers(1, 40, len(s))).astype(np.int32) for s in symbols]
    powers = kernels.RunPowers(trans, emis)
    for start, lead in ((np.full(S, 1 / S), True), (None, True), (None, False)):
        seen = []
        for lanes, left, log in powers.fragments(lengths, symbols, start, lead):
            for at, lane in enumerate(lanes):
                want, by = powers.fragment(lengths[lane], symbols[lane], start, lead)
                np.testing.assert_allclose(left[:, at], want, atol=1e-13)
                np.testing.assert_allclose(log[:, at], by, atol=1e-10)
                seen.append(lane)
        assert sorted(seen) == list(range(len(symbols)))


@pytest.mark.parametrize("most", [1, 30, 1 << 15])
def test_bundles_of_any_size_score_alike(spark, data, monkeypatch, most):
    monkeypatch.setattr(scoring, "BUNDLE_RUNS", most)
    got = scoring.forward_loglik(*data, models_table(spark, [1, 2]), 7).collect()
    assert len(got) == 6
    for row in got:
        want, _ = forward(sequences()[row.diploid, row.block_id], *random_model(row.candidate_id))
        assert row.loglik == pytest.approx(want, abs=1e-9)


def test_fragments_of_few_runs_meet_the_models_together(spark, data):
    runs, blocks = data
    scorer = scoring.Scorer.over(runs, blocks, 7)
    # three sequences of up to nine fragments: one row for the models to meet, and no product between fragments left
    assert scorer.bundles.rows.count() == 1
    assert (scorer.bundles.fan, scorer.bundles.depth) == (9, 1)
