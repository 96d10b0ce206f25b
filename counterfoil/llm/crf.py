"""A linear-chain conditional random field with two labels: training and Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BOILERPLATE, CONTENT = 0, 1


@dataclass(frozen=True)
class ChainModel:
    """Score of a labelling: weights[label] @ features of each line plus steps[label before, label]."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def decode(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of each line; rows bounds[i] to bounds[i + 1] are the lines of one text."""
        scores = ((features - self.mean) / self.scale) @ self.weights[:, 1:].T + self.weights[:, 0]
        (s00, s01), (s10, s11) = self.steps.tolist()
        labels = np.zeros(len(scores), np.int8)
        lines = scores.tolist()
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if start == end:
                continue
            a, b = lines[start]
            back = []
            for x, y in lines[start + 1 : end]:
                to_a, to_b = a + s00 < b + s10, a + s01 < b + s11
                back.append((to_a, to_b))
                a, b = (b + s10 if to_a else a + s00) + x, (b + s11 if to_b else a + s01) + y
            label = int(b > a)
            labels[end - 1] = label
            for at in range(end - 2, start - 1, -1):
                label = int(back[at - start][label])
                labels[at] = label
        return labels


def train(features: list[np.ndarray], labels: list[int], rounds: int = 300, penalty: float = 1e-3) -> ChainModel | None:
    """Fit on texts whose lines all have the text's label; None without both labels.

    Gradient ascent (with step sizes by Adam) on the likelihood of the labels, by forward and backward
    sums over all texts at once. A text counts alike whatever its length.
    """
    used = [(x, y) for x, y in zip(features, labels) if len(x)]
    if len({y for _, y in used}) < 2:
        return None
    stacked = np.concatenate([x for x, _ in used])
    mean, scale = stacked.mean(0), stacked.std(0) + 1e-6
    longest = max(len(x) for x, _ in used)
    x = np.zeros((len(used), longest, stacked.shape[1] + 1))
    live = np.zeros((len(used), longest), bool)
    for i, (lines, _) in enumerate(used):
        x[i, : len(lines), 0] = 1
        x[i, : len(lines), 1:] = (lines - mean) / scale
        live[i, : len(lines)] = True
    truth = np.array([y for _, y in used])
    share = np.bincount(truth, minlength=2)
    worth = (len(used) / (2 * share))[truth] / live.sum(1) / len(used)
    gold = np.eye(2)[truth]
    theta = np.zeros(2 * x.shape[2] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        weights, steps = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        marginal, pairs = _expected(x @ weights.T, steps, live)
        gap = (gold[:, None, :] - marginal) * (live * worth[:, None])[:, :, None]
        counted = np.einsum("ia,ib->iab", gold, gold) * (live.sum(1) - 1)[:, None, None]
        gradient = np.concatenate([
            np.einsum("ilc,ilf->cf", gap, x).ravel(),
            np.einsum("i,iab->ab", worth, counted - pairs).ravel(),
        ]) - penalty * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return ChainModel(mean, scale, theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2))


def _expected(scores: np.ndarray, steps: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label at each line, and expected number of each pair of labels in each text."""
    texts, lines, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for k in range(1, lines):
        through = _logsum(ahead[:, k - 1, :, None] + steps, 1) + scores[:, k]
        ahead[:, k] = np.where(live[:, k, None], through, ahead[:, k - 1])
    for k in range(lines - 2, -1, -1):
        through = _logsum(steps + (scores[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
        behind[:, k] = np.where(live[:, k + 1, None], through, 0)
    whole = _logsum(ahead[:, -1], 1)
    marginal = np.exp(ahead + behind - whole[:, None, None]) * live[:, :, None]
    joint = ahead[:, :-1, :, None] + steps + (scores + behind)[:, 1:, None, :] - whole[:, None, None, None]
    pairs = (np.exp(np.minimum(joint, 0)) * live[:, 1:, None, None]).sum(1)
    return marginal, pairs


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis)
    return most + np.log(np.exp(values - np.expand_dims(most, axis)).sum(axis))
