"""The positive-unlabelled risk, its gradient and the estimated class prior."""

import numpy as np
import pytest

from marginalia.llm.op10_quality import QualityModel, estimated_prior, softplus


def samples(prior, n=3_000, gap=2.5, seed=1):
    rng = np.random.default_rng(seed)
    positive = rng.normal(size=(n, 4)) + np.array([gap, 0, 0, 0])
    is_positive = rng.random(n) < prior
    unlabelled = rng.normal(size=(n, 4)) + np.where(is_positive[:, None], np.array([gap, 0, 0, 0]), np.array([-gap, 0, 0, 0]))
    return positive, unlabelled, is_positive


@pytest.mark.parametrize("prior,branch", [(0.3, "whole"), (0.95, "negative"), (None, "odds")])
def test_gradient_against_finite_differences(prior, branch):
    positive, unlabelled, _ = samples(0.5, 200)
    model = QualityModel(positive, unlabelled, prior, steps=40)
    p, u = model.scaled(positive), model.scaled(unlabelled)
    if branch == "negative":
        u = u[np.argsort(model.logits(u)[0])[:50]]  # the surest of the other class alone: the second part falls below zero
    (fp, _), (fu, _) = model.logits(p), model.logits(u)
    value, grads = model.risk(p, u)
    if prior is None:
        assert np.isclose(value, (softplus(-fp).mean() + softplus(fu).mean()) / 2)
    else:
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        assert (negative < 0) == (branch == "negative")
        assert np.isclose(value, -negative if negative < 0 else prior * softplus(-fp).mean() + negative)
    rng = np.random.default_rng(0)
    for w, g in zip(range(len(model.w)), grads):
        kept = model.w[w]
        for _ in range(3):
            way = rng.normal(size=np.shape(kept))
            both = []
            for step in (1e-6, -1e-6):
                model.w[w] = kept + step * way
                both.append(model.risk(p, u)[0])
            model.w[w] = kept
            assert np.isclose((both[0] - both[1]) / 2e-6, np.sum(g * way), rtol=1e-4, atol=1e-8)


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_prior_without_negatives(prior):
    positive, unlabelled, is_positive = samples(prior)
    assert abs(estimated_prior(positive, unlabelled) - is_positive.mean()) < 0.05


def test_prior_of_tiny_samples():
    one = np.zeros((1, 3))
    assert estimated_prior(one, one) == 0.5
    same = np.ones((10, 3))
    assert estimated_prior(same, same) == 1.0


def test_model_separates_the_classes():
    positive, unlabelled, is_positive = samples(0.4)
    model = QualityModel(positive, unlabelled, estimated_prior(positive, unlabelled))
    assert ((model.score(unlabelled) >= 0.5) == is_positive).mean() > 0.97
