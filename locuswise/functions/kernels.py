"""Array steps used inside tasks: run products, pieces of long sequences, and a chunked forward-backward pass.

Each works on one bounded batch that Spark has already grouped; nothing here knows about tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

CHUNK_CELLS = 4_000_000
#: A long sequence is worked on in so many pieces at once, each of so many sites at least.
PIECES = 256
LEAST_PIECE = 1024
#: Numbers of the vectors that are stepped side by side.
LANE_CELLS = 1 << 20
#: Symbols of holes: transitions alone, nothing at all, and (OPEN - s) for a site with symbol s that begins anew.
DRIFT, SKIP, OPEN = -1, -2, -3


def _rescale(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    peak = m.max(axis=(-2, -1))
    peak = np.where(peak > 0, peak, 1.0)
    return m / peak[:, None, None], np.log(peak)


class RunPowers:
    """Products of T.diag(E[:, symbol]) over runs, for a stack of models.

    A run of length L costs one product per set bit of L; squares are made once per symbol.
    """

    def __init__(self, trans: np.ndarray, emis: np.ndarray):
        self.trans, self.emis = trans, emis
        self._squares: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def _step(self, symbol: int) -> np.ndarray:
        if symbol == DRIFT:
            return self.trans
        if symbol <= OPEN:
            # whatever came before, the states are equally likely
            fresh = self.emis[:, None, :, OPEN - symbol] / self.trans.shape[-1]
            return np.broadcast_to(fresh, self.trans.shape)
        return self.trans * self.emis[:, None, :, symbol]

    def _enter(self, left: np.ndarray, symbol: int) -> np.ndarray:
        """A site that no transition leads into."""
        if symbol >= 0:
            return left * self.emis[:, None, :, symbol]
        return left @ self._step(symbol) if symbol <= OPEN else left

    def _power(self, symbol: int, bit: int):
        made = self._squares.setdefault(symbol, [])
        while len(made) <= bit:
            if not made:
                made.append(_rescale(self._step(symbol)))
            else:
                m, log = made[-1]
                squared, extra = _rescale(m @ m)
                made.append((squared, 2 * log + extra))
        return made[bit]

    def extend(self, left, log, symbol: int, length: int):
        if symbol == SKIP:
            return left, log
        bit = 0
        while length:
            if length & 1:
                m, own = self._power(symbol, bit)
                left, extra = _rescale(left @ m)
                log = log + own + extra
            length >>= 1
            bit += 1
        return left, log

    def ahead_of(self, right: np.ndarray, symbol: int, length: int) -> np.ndarray:
        """What follows (column vector of the first model) seen from before a run, scaled to a maximum of one."""
        bit = 0
        while length:
            if length & 1:
                right = self._power(symbol, bit)[0][0] @ right
                right = right / max(right.max(), 1e-300)
            length >>= 1
            bit += 1
        return right

    def fragment(self, lengths, symbols, start: np.ndarray | None, lead: bool):
        """Row vector(s) after the fragment if ``start`` is given, else its transfer matrix.

        With ``lead`` a transition precedes the first site; a block's first fragment has none.
        """
        count, size = self.trans.shape[:2]
        log = np.zeros(count)
        lengths = [int(n) for n in lengths]
        symbols = [int(s) for s in symbols]
        if start is not None:
            left = self._enter(np.broadcast_to(start, (count, 1, size)), symbols[0])
            lengths[0] -= 1
        elif lead:
            left = np.broadcast_to(np.eye(size), (count, size, size))
        else:
            left = self._enter(np.broadcast_to(np.eye(size), (count, size, size)), symbols[0])
            lengths[0] -= 1
        left, extra = _rescale(left)
        log = log + extra
        for length, symbol in zip(lengths, symbols):
            left, log = self.extend(left, log, symbol, length)
        return left, log

    def _times(self, left, log, rows, m, own):
        """Multiply the lanes ``rows`` of ``left`` (models, lanes, vectors, states) by one matrix per model, in place."""
        part = left[:, rows]
        part = (part.reshape(len(m), -1, m.shape[-1]) @ m).reshape(part.shape)
        peak = part.max(axis=(-2, -1))
        peak = np.where(peak > 0, peak, 1.0)
        left[:, rows] = part / peak[..., None, None]
        log[:, rows] += np.log(peak) + own[:, None]

    def fragments(self, lengths, symbols, start: np.ndarray | None, lead: bool):
        """:meth:`fragment` for many fragments, stepped side by side run by run: yields (lanes, left, log) in parts.

        ``left`` is (models, lanes, vectors, states) and ``log`` (models, lanes) of the fragments numbered ``lanes``. The
        lanes at runs of one symbol whose lengths have the same bit set share a product.
        """
        count, size = self.trans.shape[:2]
        vectors = 1 if start is not None else size
        longest_first = np.argsort([-len(x) for x in lengths], kind="stable")
        step = max(1, LANE_CELLS // (count * vectors * size))
        for at in range(0, len(longest_first), step):
            lanes = longest_first[at : at + step]
            runs = np.array([len(lengths[i]) for i in lanes])
            first = np.cumsum(runs) - runs
            n = np.concatenate([lengths[i] for i in lanes]).astype(np.int64)
            s = np.concatenate([symbols[i] for i in lanes]).astype(np.int64)
            left = np.empty((count, len(lanes), vectors, size))
            left[:] = np.eye(size) if start is None else start
            log = np.zeros((count, len(lanes)))
            if start is not None or not lead:
                for symbol in np.unique(s[first]):
                    rows = np.flatnonzero(s[first] == symbol)
                    if symbol >= 0:
                        left[:, rows] *= self.emis[:, None, None, :, symbol]
                    elif symbol <= OPEN:
                        self._times(left, log, rows, self._step(symbol), np.zeros(count))
                n[first] -= 1
            for place in range(runs[0]):
                live = np.searchsorted(-runs, -place, side="left")
                here = first[:live] + place
                for symbol in np.unique(s[here]):
                    if symbol == SKIP:
                        continue
                    rows = np.flatnonzero(s[here] == symbol)
                    rest, bit = n[here[rows]], 0
                    while rest.any():
                        odd = rows[(rest & 1) == 1]
                        if len(odd):
                            self._times(left, log, odd, *self._power(int(symbol), bit))
                        rest, bit = rest >> 1, bit + 1
            yield lanes, left, log


def chain(members: list[tuple[np.ndarray, np.ndarray]]):
    """Product of fragment transfers in order."""
    left, log = members[0]
    for m, own in members[1:]:
        left, extra = _rescale(left @ m)
        log = log + own + extra
    return left, log


def smooth(emit, lengths, trans, start, end=None, previous=None, linked=None, want_counts=False):
    """Forward-backward over a batch of sequences; yields chunks from the last to the first.

    ``emit(t0, t1)`` gives emission factors (batch, sites, states); ``start`` is the distribution
    in force at the first site, ``end`` what follows the last one (default: nothing). ``previous``
    is the distribution before the first site for the sequences flagged in ``linked``; it only
    matters for counting the transition into that site. Only the forward vectors at chunk starts
    are kept, then each chunk is redone for its backward pass. Yields ``(t0, posterior, counts)``
    with the expected transitions into the sites of the chunk per sequence, or None.
    """
    batch, states = start.shape
    total = int(lengths.max())
    chunk = max(64, CHUNK_CELLS // (batch * states))
    borders = list(range(0, total, chunk))
    last = np.ones((batch, states)) if end is None else end

    def forward(t0, t1, before):
        factors = emit(t0, t1)
        alphas = np.empty((t1 - t0, batch, states))
        for t in range(t0, t1):
            alpha = (start if t == 0 else before @ trans) * factors[:, t - t0, :]
            mass = alpha.sum(axis=1, keepdims=True)
            before = alpha / np.where(mass > 0, mass, 1.0)
            alphas[t - t0] = before
        return factors, alphas

    checkpoints = [previous]
    for t0 in borders[:-1]:
        _, alphas = forward(t0, t0 + chunk, checkpoints[-1])
        checkpoints.append(alphas[-1].copy())

    beta, following = last, None
    for t0, before in zip(reversed(borders), reversed(checkpoints)):
        t1 = min(t0 + chunk, total)
        factors, alphas = forward(t0, t1, before)
        posterior = np.empty_like(alphas)
        counts = np.zeros((batch, states, states)) if want_counts else None
        for t in range(t1 - 1, t0 - 1, -1):
            if following is not None:
                beta = (following * beta) @ trans.T
                beta = beta / np.maximum(beta.max(axis=1, keepdims=True), 1e-300)
            ended = (t >= lengths - 1)[:, None]
            beta = np.where(ended, last, beta)
            joint = alphas[t - t0] * beta
            posterior[t - t0] = joint / joint.sum(axis=1, keepdims=True)
            following = factors[:, t - t0, :]
            if want_counts and (t > 0 or (linked is not None and linked.any())):
                left = alphas[t - t0 - 1] if t > t0 else before
                pairs = left[:, :, None] * trans[None] * (following * beta)[:, None, :]
                mass = pairs.sum(axis=(1, 2), keepdims=True)
                counted = t < lengths if t > 0 else linked
                counts += np.where(
                    counted[:, None, None], pairs / np.where(mass > 0, mass, 1.0), 0.0
                )
        yield t0, posterior.transpose(1, 0, 2), counts


class Pieces(NamedTuple):
    """Stretches of sequences that are smoothed side by side, with what reaches each from both sides.

    ``row`` and ``offset`` say where a piece comes from. ``start`` is the distribution in force at its first site,
    ``before`` the one at the site ahead of it (meaningful where ``linked``), ``end`` what follows its last site.
    """

    row: np.ndarray
    offset: np.ndarray
    sites: np.ndarray
    before: np.ndarray
    start: np.ndarray
    end: np.ndarray
    linked: np.ndarray

    @staticmethod
    def joined(parts: Sequence[Pieces]) -> Pieces:
        return Pieces(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def piece_length(sites: int) -> int:
    return max(LEAST_PIECE, -(-int(sites) // PIECES))


def _linked_pieces(row, sites, step, before, start, end, linked, trans, forward, backward) -> Pieces:
    """Pieces of one sequence from ``forward(p, vector)`` and ``backward(p, vector)``, which carry a vector across piece p."""
    offset = np.arange(0, sites, step)
    count = len(offset)
    befores, starts, ends = (np.empty((count, len(trans))) for _ in range(3))
    befores[0], starts[0], ends[-1] = before, start, end
    for p in range(1, count):
        reached = forward(p - 1, befores[p - 1])
        mass = reached.sum()
        befores[p] = reached / (mass if mass > 0 else 1.0)
        starts[p] = befores[p] @ trans
        ends[count - 1 - p] = backward(count - p, ends[count - p])
    flags = np.ones(count, bool)
    flags[0] = linked
    return Pieces(np.full(count, row), offset, np.minimum(step, sites - offset), befores, starts, ends, flags)


def cut_runs(lengths: np.ndarray, symbols: np.ndarray, step: int) -> list[tuple[list[int], list[int]]]:
    """Runs cut at every ``step`` sites, piece by piece."""
    stops = np.cumsum(lengths)
    total = int(stops[-1])
    edges = np.union1d(stops, np.arange(step, total, step))
    sizes = np.diff(edges, prepend=0)
    codes = np.asarray(symbols)[np.searchsorted(stops, edges, side="left")]
    borders = np.searchsorted(edges, np.arange(step, total, step), side="right")
    return [(a.tolist(), b.tolist()) for a, b in zip(np.split(sizes, borders), np.split(codes, borders), strict=True)]


def run_pieces(powers: RunPowers, row, lengths, symbols, start, end=None, before=None, linked=False) -> Pieces:
    """Pieces of a sequence of runs under the first model of ``powers``.

    The vectors at the borders are carried along the runs (one product per set bit of a run's length), so the
    steps that remain are those inside one piece, taken for all pieces at once.
    """
    trans = powers.trans[0]
    states = len(trans)
    sites = int(np.sum(lengths))
    step = piece_length(sites)
    runs = cut_runs(lengths, symbols, step)

    def forward(p, vector):
        if p == 0:
            return powers.fragment(*runs[0], start, lead=False)[0][0, 0]
        left, log = vector[None, None], np.zeros(1)
        for length, symbol in zip(*runs[p], strict=True):
            left, log = powers.extend(left, log, symbol, length)
        return left[0, 0]

    def backward(p, vector):
        for length, symbol in zip(reversed(runs[p][0]), reversed(runs[p][1]), strict=True):
            vector = powers.ahead_of(vector, symbol, length)
        return vector

    end = np.ones(states) if end is None else end
    return _linked_pieces(row, sites, step, start if before is None else before, start, end, linked, trans, forward, backward)


def _piece_transfers(factors: np.ndarray, trans: np.ndarray, start: np.ndarray | None, step: int):
    """Transfer of each piece of a sequence of emission factors (sites, states), all pieces stepped together.

    With ``start`` the first piece gives a row vector (in the first row of its matrix), and no transition leads its
    first site.
    """
    sites, states = factors.shape
    count = -(-sites // step)
    padded = np.ones((count * step, states))
    padded[:sites] = factors
    padded = padded.reshape(count, step, states)
    last = sites - (count - 1) * step
    left, log = np.broadcast_to(np.eye(states), (count, states, states)).copy(), np.zeros(count)
    for t in range(min(step, sites)):
        moving = count if t < last else count - 1
        stepped = left[:moving] @ (trans[None] * padded[:moving, t, None, :])
        if t == 0 and start is not None:
            stepped[0] = 0.0
            stepped[0, 0] = start * padded[0, 0]
        left[:moving], extra = _rescale(stepped)
        log[:moving] += extra
    return left, log


def factor_pieces(row, factors, trans, start, end=None, before=None, linked=False) -> Pieces:
    """Pieces of a sequence of emission factors; see :func:`run_pieces`."""
    sites, states = factors.shape
    step = piece_length(sites)
    if sites > step:
        moves, _ = _piece_transfers(factors, trans, start, step)

    def forward(p, vector):
        return moves[0][0] if p == 0 else vector @ moves[p]

    def backward(p, vector):
        vector = moves[p] @ vector
        return vector / max(vector.max(), 1e-300)

    end = np.ones(states) if end is None else end
    return _linked_pieces(row, sites, step, start if before is None else before, start, end, linked, trans, forward, backward)


def dense_transfer(factors: np.ndarray, trans: np.ndarray, start: np.ndarray | None):
    """Transfer of one sequence of emission factors (sites, states); a transition leads each site
    except the first one of a block, which takes ``start``. Long sequences are stepped in pieces side by side."""
    moves, logs = _piece_transfers(factors, trans, start, piece_length(len(factors)))
    members = [(moves[p][None], logs[p : p + 1]) for p in range(len(moves))]
    if start is not None:
        members[0] = (members[0][0][:, :1], members[0][1])
    return chain(members)
