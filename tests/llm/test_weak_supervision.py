"""The label model of operator 8 against plain loops, and that labels don't stand in for it."""

import math

import numpy as np
import pytest

from strandframe.llm import toxicity


def loops(votes, first, rounds):
    """Expectation maximisation of one clean and one toxic class, with weights from correlations, number by number."""
    n, m = len(votes), len(votes[0])
    share = first.share
    seen, size = first.seen, first.size
    chance = lambda row, k, fires, weight: math.exp(math.log(share[k]) + sum(weight[v] * math.log(fires[k][v] if row[v] else 1 - fires[k][v]) for v in range(m)))
    both = [[chance(r, k, first.fires, first.weight) for k in (0, 1)] for r in votes]
    p = [b[1] / sum(b) for b in both]
    share = [min(max(s / sum(size), 1e-4), 1 - 1e-4) for s in size]
    weight = [1.0] * m
    for step in range(rounds):
        of = [[1 - x, x] for x in p]
        fires = [[min(max((sum(of[i][k] * votes[i][v] for i in range(n)) + seen[k][v] + 0.05) / (sum(o[k] for o in of) + size[k] + 1), 1e-6), 1 - 1e-6) for v in range(m)] for k in (0, 1)]
        if step % 8 == 0:
            rest = [[votes[i][v] - of[i][0] * fires[0][v] - of[i][1] * fires[1][v] for v in range(m)] for i in range(n)]
            norm = [math.sqrt(sum(rest[i][v] ** 2 for i in range(n))) + 1e-9 for v in range(m)]
            weight = []
            for v in range(m):
                alike = [sum(rest[i][v] * rest[i][w] for i in range(n)) / (norm[v] * norm[w]) for w in range(m) if w != v]
                weight.append(1 / (1 + sum(min(a, 1) for a in alike if a >= 0.05)))
        both = [[chance(r, k, fires, weight) for k in (0, 1)] for r in votes]
        p = [b[1] / sum(b) for b in both]
    return p


def made(rng, n):
    y = (rng.random(n) < 0.3).astype(int)
    vote = lambda hit, noise: (rng.random(n) < np.where(y, hit, noise)).astype(float)
    one = vote(0.7, 0.05)
    return y, np.stack([one, np.where(rng.random(n) < 0.1, 1 - one, one), vote(0.5, 0.1), vote(0.6, 0.2), vote(0.4, 0.02)], axis=1)


def test_posteriors_are_those_of_plain_loops():
    rng = np.random.default_rng(1)
    y, votes = made(rng, 60)
    first = toxicity.LabelModel(votes[:30], y[:30].astype(float), 0.98, 1)
    model = toxicity.LabelModel(votes[30:], np.full(30, np.nan), 0.98, 10, 1, first)
    assert model.posterior(votes[30:]) == pytest.approx(loops(votes[30:].tolist(), first, 10), abs=1e-9)
    assert model.weight[0] < model.weight[4] and model.weight[1] < model.weight[4]


def test_unlabelled_rows_are_told_apart():
    """Few labels say which class is which; what the voters are worth comes from rows without."""
    rng = np.random.default_rng(2)
    y, votes = made(rng, 6000)
    first = toxicity.LabelModel(votes[:200], y[:200].astype(float), 0.98, 1)
    p = toxicity.LabelModel(votes[200:], np.full(5800, np.nan), 0.98, 25, 1, first).posterior(votes[200:])
    assert ((p > 0.5) == y[200:]).mean() > 0.85 and 0.01 < np.abs(p - y[200:]).mean() < 0.3


def test_kinds_of_abuse():
    """Voters of one kind of text don't speak against another kind on which they never fire."""
    rng = np.random.default_rng(3)
    kind = rng.choice([0, 0, 0, 0, 1, 2], 4000)
    rate = np.array([[0.02] * 8, [0.6] * 6 + [0.01] * 2, [0.01] * 6 + [0.7] * 2])
    votes = (rng.random((4000, 8)) < rate[kind]).astype(float)
    first = toxicity.LabelModel(votes[:600], (kind[:600] > 0).astype(float), 0.98, 25, 3)
    p = toxicity.LabelModel(votes[600:], np.full(3400, np.nan), 0.98, 25, 3, first).posterior(votes[600:])
    assert ((p > 0.5) == (kind[600:] > 0))[kind[600:] == 2].mean() > 0.85 and ((p > 0.5) == (kind[600:] > 0)).mean() > 0.93  # the best rule is right for 0.959


def test_a_classifier_learns_posteriors_of_rows_without_labels():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    toxic = rng.random(900) < 0.3
    docs = [sorted({f"w{k}" for k in rng.integers(0, 300, 30)} | (set(rng.choice(["idiot", "moron", "loser", "scum"], 2)) | {"blorf"} if t else set())) for t in toxic]
    labels = np.where(np.arange(900) < 300, toxic, np.nan)
    how = toxicity.WeakSupervision()
    model = toxicity.train(pa.array(docs), np.zeros((900, 1)), labels, np.arange(900) >= 300, how)
    assert model.score("idiot scum blorf") > 0.5 > model.score("w1 w2 w3")
