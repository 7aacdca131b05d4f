"""Forward filtering of an unbounded stream of sites, one hidden chain per (diploid, block)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from locuswise.functions.kernels import RunPowers
from locuswise.operators.calling import MISSING
from locuswise.operators.scoring import Model

OUTPUT = "diploid long, block_id int, pos long, dist array<double>, loglik double"
STATE = "dist array<double>, loglik double, last long"
#: Steps (a number of skipped positions, a symbol) whose matrices a Python worker keeps.
STEPS = 4096


def stream_filter(sites: DataFrame, model: Model) -> DataFrame:
    """Filtered state distribution and running log-likelihood at every arriving site.

    ``sites(diploid, block_id, pos, state, seq)``. The distribution and the last position are kept
    between micro-batches. Positions skipped by the stream count as missing. A row at or before the
    last position of its key is late: it comes out with a null ``dist`` and ``loglik`` and changes nothing.
    Of repeats inside a batch the lowest ``seq`` counts.
    """
    size, powers = model.states, RunPowers(model.trans[None], model.emis[None])

    made = {}

    def step(skipped: int, symbol: int):
        """Across positions that count as missing and on to a symbol, as one matrix and the log of its scale."""
        if (skipped, symbol) not in made:
            if len(made) >= STEPS:
                made.clear()
            matrix, log = powers.extend(np.eye(size)[None], np.zeros(1), MISSING, skipped)
            matrix, log = powers.extend(matrix, log, symbol, 1)
            made[skipped, symbol] = matrix[0], float(log[0])
        return made[skipped, symbol]

    def advance(key, frames, state):
        if state.exists:
            dist, loglik, last = state.get
            vector, last = np.array(dist), int(last)
        else:
            vector, loglik, last = None, 0.0, None
        frames = list(frames)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        pos, seq, symbols = (rows[c].to_numpy() for c in ("pos", "seq", "state"))
        order = np.lexsort((seq, pos))
        pos, symbols = pos[order], symbols[order]
        fresh = np.ones(len(pos), bool)
        fresh[1:] = pos[1:] != pos[:-1]
        pos, symbols = pos[fresh], symbols[fresh]
        if last is not None:
            late, symbols = pos[pos <= last], symbols[pos > last]
            pos = pos[pos > last]
            if len(late):
                yield pd.DataFrame(
                    {"diploid": key[0], "block_id": key[1], "pos": late, "dist": None, "loglik": None}
                ).astype({"loglik": "float64"})
        if not len(pos):
            return
        skipped = np.diff(pos, prepend=pos[0] - 1 if last is None else last) - 1
        dists, masses, logs = [], [], []
        for gap, symbol in zip(skipped.tolist(), symbols.tolist()):
            if vector is None:
                vector, log = model.emis[:, symbol] / size, 0.0
            else:
                matrix, log = step(gap, symbol)
                vector = vector @ matrix
            mass = vector.sum()
            vector = vector / mass
            dists.append(vector)
            masses.append(mass)
            logs.append(log)
        logliks = float(loglik) + np.cumsum(np.array(logs) + np.log(masses))
        state.update((vector.tolist(), float(logliks[-1]), int(pos[-1])))
        yield pd.DataFrame(
            {"diploid": key[0], "block_id": key[1], "pos": pos, "dist": dists, "loglik": logliks}
        )

    return sites.groupBy("diploid", "block_id").applyInPandasWithState(
        advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
