"""Linear-chain and skip-chain conditional random fields on named features (numpy)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Chain(NamedTuple):
    """Weights of features by label, and of the steps between labels."""

    names: dict[str, int]
    state: np.ndarray
    step: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def emissions(self, tokens: list[list[str]]) -> np.ndarray:
        """Log-potential of each label at each token; unknown features count nothing."""
        out = np.zeros((len(tokens), self.state.shape[1]))
        for t, features in enumerate(tokens):
            known = [self.names[f] for f in features if f in self.names]
            if known:
                out[t] = self.state[known].sum(axis=0)
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train_chain(sequences: list[list[list[str]]], labels: list[list[int]], n_labels: int, steps: int = 150, l2: float = 1e-3, rate: float = 0.1, ends: bool = True) -> Chain:
    """Likeliest weights by Adam steps over all sequences, with exact forward and backward sums.

    Without ``ends`` the steps to and from a sequence's ends weigh nothing.
    """
    names: dict[str, int] = {}
    at, owner = [], []
    longest = max(map(len, sequences))
    gold = np.zeros((len(sequences), longest), np.int64)
    mask = np.zeros((len(sequences), longest), bool)
    for s, (tokens, answer) in enumerate(zip(sequences, labels, strict=True)):
        gold[s, : len(answer)], mask[s, : len(answer)] = answer, True
        for t, features in enumerate(tokens):
            for f in features:
                at.append(names.setdefault(f, len(names)))
                owner.append(s * longest + t)
    at, owner = np.array(at), np.array(owner)
    sizes = mask.sum(axis=1)
    rows = np.arange(len(sequences))
    one = np.eye(n_labels)[gold] * mask[..., None]
    shapes = [(len(names), n_labels), (n_labels, n_labels), (n_labels,), (n_labels,)]
    weights = [np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for k in range(1, steps + 1):
        state, step, start, end = weights
        score = np.stack(
            [np.bincount(owner, weights=state[at, y], minlength=gold.size) for y in range(n_labels)], axis=-1
        ).reshape(*gold.shape, n_labels)
        ahead = np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], score[:, t] + _log_sum(ahead[:, t - 1, :, None] + step, 1), ahead[:, t - 1])
        back = np.zeros_like(score)
        back[:] = end
        for t in range(longest - 2, -1, -1):
            flow = _log_sum(step + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], flow, end)
        total = _log_sum(ahead[rows, sizes - 1] + end, 1)
        belief = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        gap = belief - one
        pair = np.exp(ahead[:, :-1, :, None] + step + (score + back)[:, 1:, None, :] - total[:, None, None, None])
        pair = (pair * mask[:, 1:, None, None]).sum(axis=(0, 1)) - np.einsum("sta,stb->ab", one[:, :-1], one[:, 1:])
        slopes = [
            np.stack([np.bincount(at, weights=gap.reshape(-1, n_labels)[owner, y], minlength=len(names)) for y in range(n_labels)], axis=-1),
            pair,
            ends * gap[:, 0].sum(axis=0),
            ends * gap[rows, sizes - 1].sum(axis=0),
        ]
        for i, slope in enumerate(slopes):
            slope = slope / len(sequences) + l2 * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
    return Chain(names, *weights)


def viterbi(score: np.ndarray, chain: Chain) -> list[int]:
    """The likeliest labels of one sequence; of equal ones the smallest labels, from the end."""
    if not len(score):
        return []
    best, came = score[0] + chain.start, []
    for row in score[1:]:
        ways = best[:, None] + chain.step
        came.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    path = [int((best + chain.end).argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1]


def loopy_beliefs(score: np.ndarray, chain: Chain, links: list[tuple[int, int]], bond: np.ndarray, rounds: int = 12, damp: float = 0.5) -> np.ndarray:
    """Label beliefs of one sequence with extra links between distant tokens (``bond``: their log-potential).

    Each round runs the exact forward and backward sums along the chain with what the links say, then lets the two
    ends of every link send what they believe without each other. Messages are damped; without links one round is exact.
    """
    n, labels = score.shape
    says = np.zeros((2, len(links), labels))  # to the second end, to the first end
    ends = np.array(links, np.int64).reshape(-1, 2)
    for _ in range(rounds if links else 1):
        full = score.copy()
        np.add.at(full, ends[:, 1], says[0])
        np.add.at(full, ends[:, 0], says[1])
        ahead, back = np.zeros_like(full), np.zeros_like(full)
        ahead[0] = full[0] + chain.start
        for t in range(1, n):
            ahead[t] = full[t] + _log_sum(ahead[t - 1][:, None] + chain.step, 0)
        back[-1] = chain.end
        for t in range(n - 2, -1, -1):
            back[t] = _log_sum(chain.step + (full[t + 1] + back[t + 1])[None, :], 1)
        belief = ahead + back
        belief -= _log_sum(belief, 1)[:, None]
        if not links:
            break
        new = np.stack(
            [
                _log_sum((belief[ends[:, 0]] - says[1])[:, :, None] + bond, 1),
                _log_sum((belief[ends[:, 1]] - says[0])[:, :, None] + bond.T, 1),
            ]
        )
        new -= new.max(axis=2, keepdims=True)
        change = np.abs(new - says).max()
        says = damp * says + (1 - damp) * new
        if change < 1e-3:
            break
    return belief
