"""The label model against expectation-maximisation in explicit loops, row by row."""

import random
from collections import Counter

import numpy as np
import pytest

from jobtrail.llm import weak_labels


def plain_em(rows, rounds):
    """Posterior of good for every row: counts of votes weighted by the posteriors of the round before."""
    n = len(rows[0])
    start = {0: (0.3, 0.1, 0.6), 1: (0.02, 0.13, 0.85)}
    table = {(c, k, v): start[c][v + 1] for c in (0, 1) for k in range(n) for v in (-1, 0, 1)}
    prior = {0: 0.15, 1: 0.85}

    def posterior(row):
        likely = {}
        for c in (0, 1):
            likely[c] = prior[c]
            for k, v in enumerate(row):
                likely[c] *= table[c, k, v]
        return {c: x / (likely[0] + likely[1]) for c, x in likely.items()}

    for _ in range(rounds):
        told = [posterior(row) for row in rows]
        for c in (0, 1):
            for k in range(n):
                sums = {v: 0.1 + sum(p[c] for p, row in zip(told, rows) if row[k] == v) for v in (-1, 0, 1)}
                for v in sums:
                    table[c, k, v] = sums[v] / sum(sums.values())
        prior = {c: (1 + sum(p[c] for p in told)) / (2 + len(rows)) for c in (0, 1)}
    return [posterior(row)[1] for row in rows]


@pytest.mark.parametrize("seed, rounds", [(1, 1), (2, 3), (3, 20)])
def test_label_model_against_plain_em(seed, rounds):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        good = rng.random() < 0.8
        rows.append(tuple((1 if good == (rng.random() < p) else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.9, 0.8, 0.6)))
    counts = Counter(rows)
    patterns = np.array(list(counts), np.int8)
    model = weak_labels.LabelModel(patterns, np.array(list(counts.values()), float), rounds=rounds)
    assert model.good(np.array(rows, np.int8)) == pytest.approx(plain_em(rows, rounds), abs=1e-9)
