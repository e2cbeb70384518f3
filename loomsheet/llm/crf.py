"""A linear-chain conditional random field over numpy: training by Adam, exact decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2


@dataclass(frozen=True)
class Model:
    """``weights``: feature by tag; ``moves``: tag by next tag."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return features.astype(np.float32) @ self.weights.astype(np.float32)

    def margin(self) -> float:
        """The most that transitions can gain where one tag other than outside replaces outside."""
        m = np.pad(self.moves, ((0, 1), (0, 1)))  # the last row and column: no neighbour
        gains = [m[a, t] + m[t, b] - m[a, OUTSIDE] - m[OUTSIDE, b] for t in (BEGIN, INSIDE) for a in range(4) for b in range(4)]
        return float(max(gains))


def viterbi(scores: np.ndarray, moves: np.ndarray, before: int | None, after: int | None) -> list[int]:
    """The best tags of a stretch, given the tags beside it (None: the text ends)."""
    s, m = scores.tolist(), moves.tolist()
    best = [s[0][t] + (m[before][t] if before is not None else 0.0) for t in range(3)]
    back = []
    for row in s[1:]:
        step, came = [], []
        for t in range(3):
            a = max(range(3), key=lambda k, t=t: best[k] + m[k][t])
            came.append(a)
            step.append(best[a] + m[a][t] + row[t])
        best = step
        back.append(came)
    if after is not None:
        best = [best[t] + m[t][after] for t in range(3)]
    tags = [max(range(3), key=best.__getitem__)]
    for came in reversed(back):
        tags.append(came[tags[-1]])
    return tags[::-1]


def tag(model: Model, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tags of many texts at once; text k has the tokens first[k]:first[k + 1].

    A token whose outside score leads by more than ``margin`` is outside in
    every best path, since changing it to outside would gain. Such tokens cut
    the texts into short stretches, each of which is decoded exactly.
    """
    tags = np.zeros(len(scores), np.int8)
    open_ = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) <= model.margin() + 1e-4
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    starts = np.zeros(len(scores) + 1, bool)
    starts[first] = True
    cut = np.flatnonzero((np.diff(at) > 1) | starts[at[1:]]) + 1
    for run in np.split(at, cut):
        a, b = int(run[0]), int(run[-1]) + 1
        tags[a:b] = viterbi(scores[a:b], model.moves, None if starts[a] else OUTSIDE, None if starts[b] or b == len(scores) else OUTSIDE)
    return tags


def train(features: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> Model:
    """``features``: sequence by place by feature; ``tags`` and ``mask``: sequence by place. Padding lies at the ends."""
    n, length, width = features.shape
    x = np.ascontiguousarray(features.reshape(-1, width), dtype=np.float32)
    w, m = np.zeros((width, 3)), np.zeros((3, 3))
    one = np.eye(3)[tags] * mask[..., None]
    pair_mask = mask[:, :-1] & mask[:, 1:]
    seen = np.einsum("nli,nlj->ij", one[:, :-1] * pair_mask[..., None], one[:, 1:])
    seen_x = x.T @ one.reshape(-1, 3).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, m)]
    total = max(1, int(mask.sum()))
    for step in range(1, steps + 1):
        e = (x @ w.astype(np.float32)).reshape(n, length, 3).astype(np.float64)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        moves = np.exp(m - m.max())
        ahead, behind = np.empty((length, n, 3)), np.ones((length, n, 3))  # each row scaled to a sum of 1, which cancels out
        ahead[0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for k in range(1, length):
            a = (ahead[k - 1] @ moves) * e[:, k]
            ahead[k] = np.where(mask[:, k, None], a / a.sum(axis=1, keepdims=True), ahead[k - 1])
        for k in range(length - 2, -1, -1):
            a = (e[:, k + 1] * behind[k + 1]) @ moves.T
            behind[k] = np.where(mask[:, k + 1, None], a / a.sum(axis=1, keepdims=True), behind[k + 1])
        p = ahead * behind
        p = (p / p.sum(axis=2, keepdims=True)).transpose(1, 0, 2) * mask[..., None]
        expected = np.zeros((3, 3))
        for k in range(length - 1):
            later = e[:, k + 1] * behind[k + 1]
            share = pair_mask[:, k] / ((ahead[k] @ moves) * later).sum(axis=1)
            expected += moves * ((ahead[k] * share[:, None]).T @ later)
        slopes = [(x.T @ p.reshape(-1, 3).astype(np.float32) - seen_x) / total + penalty * w / 10, (expected - seen) / total + penalty * m / 10]
        for q, g, (a, b) in zip((w, m), slopes, moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return Model(w, m)
