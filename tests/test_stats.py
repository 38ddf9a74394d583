"""Student's t against tabled values and its finite series for whole degrees of freedom."""

import math

import numpy as np
import pytest

from marketflow.functions import stats as S
from marketflow.operators import fit as FT


def by_series(t, df):
    angle = math.atan(abs(t) / math.sqrt(df))
    cos, first = math.cos(angle), df % 2
    term = total = cos if first else 1.0
    if df == 1:
        total = 0.0
    for k in range(first + 2, df - 1, 2):
        term *= cos * cos * (k - 1) / k
        total += term
    return 1 - (2 / math.pi * (angle + math.sin(angle) * total) if first else math.sin(angle) * total)


@pytest.mark.parametrize(("df", "t"), [(1, 12.7062), (2, 4.3027), (10, 2.2281), (30, 2.0423), (120, 1.9799), (10**9, 1.95996)])
def test_tabled_bounds_of_five_percent(df, t):
    assert S.student_t_tails([t], [df])[0] == pytest.approx(0.05, abs=1e-5)  # the tables give four decimals of t


def test_tails_equal_the_series():
    cases = [(t, df) for df in (1, 2, 3, 4, 9, 79, 80, 81, 82, 1000, 20001) for t in (0.0, 1e-9, 0.3, 1.0, 1.96, 4.0, 12.0)]
    got = S.student_t_tails([t for t, _ in cases], [df for _, df in cases])
    assert np.abs(got - np.array([by_series(t, df) for t, df in cases])).max() < 1e-11


def test_ends_of_the_range():
    got = S.student_t_tails([np.inf, 1e200, 0.0, np.nan, 1.0], [3, 5, 5, 3, 0])
    assert got[:3].tolist() == [0.0, 0.0, 1.0] and np.isnan(got[3:]).all()


def test_small_groups_and_flat_values(spark):
    rows = [("two", 1.0), ("two", 3.0), ("one", 2.0), ("flat", 0.5), ("flat", 0.5), ("zero", 0.0), ("zero", 0.0), ("none", None), (None, 1.0), (None, 2.0), (None, 4.0)]
    got = {r["k"]: r for r in FT.t_test(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["two"]["p_value"] == pytest.approx(1 - 2 / math.pi * math.atan(2.0)) and not got["two"]["reject"]
    assert (got["one"]["p_value"], got["flat"]["p_value"], got["zero"]["p_value"], got["none"]["p_value"]) == (0.0, 0.0, 1.0, None)
    assert got["flat"]["t_stat"] is None and got["none"]["reject"] is None
    assert got[None]["p_value"] == pytest.approx(by_series(got[None]["t_stat"], 2))
