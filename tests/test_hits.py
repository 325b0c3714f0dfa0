"""Queries whose places are among their points, against their SQL twins."""

import numpy as np
import pandas as pd
import pytest
from compare import connect, rows

from geostrata.plans import registry


@pytest.fixture(scope="module")
def met(tmp_path_factory):
    """Tables in which every fifth customer is where a supplier is, and two suppliers are at one place."""
    path, rng = tmp_path_factory.mktemp("met"), np.random.default_rng(11)
    s = pd.DataFrame({"s_suppkey": np.arange(40), "s_nationkey": rng.integers(0, 25, 40), "s_acctbal": rng.integers(-99_999, 1_000_000, 40) / 100})
    s.loc[9, ["s_nationkey", "s_acctbal"]] = s.loc[4, ["s_nationkey", "s_acctbal"]]
    s["s_nationkey"] = s["s_nationkey"].astype("int32")
    s = pd.concat([s, s.assign(s_suppkey=s["s_suppkey"] + 4001, s_acctbal=(s["s_acctbal"] / 2).round(2))])
    c = pd.DataFrame({"c_custkey": np.arange(60), "c_nationkey": rng.integers(0, 25, 60).astype("int32"), "c_acctbal": rng.integers(-99_999, 1_000_000, 60) / 100})
    for k in range(0, 60, 5):
        c.loc[k, ["c_nationkey", "c_acctbal"]] = s.iloc[k][["s_nationkey", "s_acctbal"]].to_numpy()
    c["c_nationkey"] = c["c_nationkey"].astype("int32")
    s.to_parquet(path / "supplier.parquet", index=False)
    c.to_parquet(path / "customer.parquet", index=False)
    return str(path)


@pytest.mark.parametrize("name", ["field_interpolate", "idw_radius", "muter_field", "refractor_refined"])
def test_query_where_places_are_points(spark, met, name):
    found, wanted = registry.QUERIES[name](spark, met).toPandas(), connect(met).sql(registry.ORACLE_SQL[name]).df()
    assert len(wanted) and sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
