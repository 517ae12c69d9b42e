"""The fit against a likelihood written out document by document."""

import math

import numpy as np
from test_ordinal import synthetic

from locusframe.llm import ordinal


def loss(model, docs, grades):
    """Mean negative log-likelihood and penalty of rows of {feature: value}."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    total = 0.0
    for own, grade in zip(docs, grades):
        score = sum(model.weights[k] * v for k, v in own.items())
        up = sigmoid(model.thresholds[grade] - score) if grade < ordinal.GRADES - 1 else 1.0
        down = sigmoid(model.thresholds[grade - 1] - score) if grade else 0.0
        total -= math.log(max(up - down, 1e-12))
    return total / len(docs) + ordinal.PENALTY / 2 * float((model.weights**2).sum())


def test_no_step_away_is_better():
    rows = synthetic(240, seed=9)
    starts, numbers, values = ordinal.features([r[1].encode() for r in rows])
    grades = np.array([r[2] for r in rows])
    docs = [{} for _ in rows]
    for i, own in enumerate(docs):
        for k, v in zip(numbers[starts[i] : starts[i + 1]], values[starts[i] : starts[i + 1]]):
            own[int(k)] = own.get(int(k), 0.0) + float(v)
    grades = np.where(np.arange(len(rows)) % 10 == 0, (grades + 1) % 3, grades)  # some ratings off, so that the optimum is finite
    model = ordinal.fit(starts, numbers, values, grades)
    best = loss(model, docs, grades)
    used = np.flatnonzero(model.weights)
    assert len(used) and best < 0.9
    rng = np.random.default_rng(1)
    for step in (0.3, 0.1):
        for _ in range(20):
            weights, thresholds = model.weights.copy(), np.sort(model.thresholds + rng.normal(0, step, 2))
            weights[used] += rng.normal(0, step, len(used))
            word = used[used < ordinal.DIMENSIONS // 2]
            weights[word] = np.minimum(weights[word], 0)
            assert loss(ordinal.Model(weights, thresholds), docs, grades) > best - 1e-3


def test_probabilities_are_differences_of_the_links():
    model = ordinal.Model(np.zeros(ordinal.DIMENSIONS), np.array([-1.0, 0.5]))
    for score in (-3.0, 0.0, 2.5):
        upto = [1 / (1 + math.exp(-(t - score))) for t in (-1.0, 0.5)]
        assert np.allclose(model.probabilities(np.array([score]))[0], [upto[0], upto[1] - upto[0], 1 - upto[1]])
