"""Quantiles by selection, against numpy: large groups, ties, NULLs, single rows, keys that are NULL."""

import numpy as np
import pytest

from terracell.operators.reduce import quantiles, selected

AT = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [("big", float(x)) for x in rng.normal(size=5000)] + [("ties", float(x)) for x in rng.integers(0, 4, 800)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("null", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    got = {r["k"]: r for r in selected(df, ["k"], "v", AT).collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert [got[k][n] for n in AT] == pytest.approx([float(np.quantile(values, q)) for q in AT.values()])
    whole = selected(df, [], "v", AT).collect()
    assert len(whole) == 1 and list(whole[0]) == pytest.approx([float(np.quantile([v for vs in want.values() for v in vs], q)) for q in AT.values()])
    plain = {r["k"]: r for r in quantiles(df.where("v is not null"), ["k"], "v", AT).collect()}
    assert all([plain[k][n] for n in AT] == pytest.approx([got[k][n] for n in AT]) for k in want)
    assert selected(df.where("false"), ["k"], "v", AT).count() == 0 and selected(df.where("false"), [], "v", AT).count() == 0
