import math

import numpy as np
import pytest

from cohortspark.functions import stats


def test_distributions_at_known_points():
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert stats.chi2_sf(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-10)
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, abs=1e-9)
    assert stats.t_two_sided(2.7764451051977987, 4) == pytest.approx(0.05, abs=1e-10)
    assert stats.binomial_two_sided(5, 5) == pytest.approx(0.0625)
    assert stats.binomial_two_sided(3, 6) == 1.0


def test_hommel_lies_between_hochberg_and_raw():
    p = np.array([0.01, 0.02, 0.03, 0.2, 0.9])
    h = stats.hommel(p)
    m = len(p)
    hochberg = np.minimum.accumulate((p * (m - np.arange(m)))[::-1])[::-1]
    assert (h >= p).all() and (h <= np.minimum(hochberg, 1) + 1e-12).all()


def test_search_adjusted_p_is_above_the_naive_one():
    for b in (2.0, 2.5, 3.0, 4.0):
        assert stats.normal_two_sided(b) < stats.lausen_schumacher(b) <= 1
    assert math.isclose(stats.lausen_schumacher(0.0), 1.0)
