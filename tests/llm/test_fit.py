"""The ordinal regression's fit against a plain minimiser of the same loss."""

import math
import random

import pytest

from sparkloom.llm import toxicity


def brute_loss(rows, weights, theta, ridge):
    """Mean log loss of P(toxic) = 1 / (1 + exp(theta - sum of weights)), and the ridge."""
    total = 0.0
    for t, held in rows:
        z = sum(weights[f] for f in held) - theta
        total += math.log1p(math.exp(-z if t else z))
    return total / len(rows) + ridge / 200 * sum(w * w for w in weights.values())


def minimised(rows, names, ridge, steps=1500, rate=0.5):
    """Plain gradient descent from zero, all by loops."""
    weights, theta = dict.fromkeys(names, 0.0), 0.0
    for _ in range(steps):
        dw, dt = {f: ridge / 100 * weights[f] for f in names}, 0.0
        for t, held in rows:
            err = 1 / (1 + math.exp(theta - sum(weights[f] for f in held))) - t
            for f in held:
                dw[f] += err / len(rows)
            dt -= err / len(rows)
        weights = {f: weights[f] - rate * dw[f] for f in names}
        theta -= rate * dt
    return weights, theta


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_is_the_minimum(spark, seed):
    rng = random.Random(seed)
    # Every word stands in texts of either label, so that no text has words of toxic texts alone: the grades are the labels.
    texts = []
    for k in range(240):
        t = k % 2
        words = [w for w, p in (("bad", (0.2, 0.7)), ("mean", (0.1, 0.4)), ("good", (0.7, 0.3)), ("fine", (0.6, 0.35)), ("even", (0.5, 0.5)), ("odd", (0.3, 0.3))) if rng.random() < p[t]]
        texts.append((k, " ".join(words), t))
    docs = spark.createDataFrame([(k, x) for k, x, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rounds=3000, ridge=0.1)
    assert model["levels"] == [0, 1] and {"bad", "good"} <= set(model["weights"]) and "odd" not in model["weights"]
    rows = [(t, [f for f in toxicity.text_features(x) if f in model["weights"]]) for _, x, t in texts]
    weights, theta = minimised(rows, list(model["weights"]), 0.1)
    assert brute_loss(rows, model["weights"], model["thetas"][0], 0.1) == pytest.approx(brute_loss(rows, weights, theta, 0.1), abs=2e-3)
    assert model["weights"]["bad"] > 0 > model["weights"]["good"]
