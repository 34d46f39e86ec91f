"""The factorization machine learns pairs with the settings it is used with."""

import random

import numpy as np

from gleanguard.llm.toxicity import FactorizationMachine, Terms


def test_pairs_are_learned_as_in_production():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(50)}" for _ in range(6)] + ["insult"] * insult + ["people"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(insult == group))
    rows, y = Terms().places(texts), np.array(labels)
    model = FactorizationMachine().fit(rows[:3000], y[:3000])
    held = np.array(model.logits(rows[3000:]))
    assert np.mean((held >= 0) == (y[3000:] > 0)) > 0.95
    model.v = np.zeros_like(model.v)
    assert np.abs(held - model.logits(rows[3000:])).max() > 1
