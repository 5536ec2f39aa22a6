import numpy as np
import pytest

from quillspark.llm import near_dup as nd


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_agreement_of_long_texts(n):
    """Changed shingles heavier than the common ones: samples must still agree like the weighted similarity."""
    rng = np.random.default_rng(4)
    common = np.unique(rng.integers(1 << 63, size=n).astype(np.uint64))
    agree, samples = [], 256
    for seed in (1, 2):
        sides = []
        for part in (1, 2):
            changed = np.random.default_rng(10 * seed + part).integers(1 << 63, size=n // 13).astype(np.uint64)
            keys = np.concatenate((common, changed))
            weights = np.concatenate((np.full(len(common), 1.0), np.full(len(changed), 1.6)))
            order = np.argsort(keys)
            sides.append((keys[order], weights[order]))
        sampler = nd.Sampler(samples, samples, seed=seed)
        agree.append(sampler.draw(*sides[0]) == sampler.draw(*sides[1]))
    assert abs(np.mean(agree) - nd.jaccard(*sides)) < 0.06
