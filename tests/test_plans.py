"""Physical-plan properties: pruning and pushdown reach the parquet scan,
money aggregates are partial (map-side), hot keys aggregate correctly."""

import numpy as np
import pytest

from mensura.operators import filters as fl
from mensura.operators import linear as lin
from mensura.plans import panels
from mensura.sources.tables import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    o = table(spark, SF, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    p = plan(fl.filter_eq(o, "o_orderstatus", "F").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_panel_scan_prunes_and_aggregates_partially(spark):
    p = plan(panels.rev_panel(spark, SF).select("series_id", "period", "target"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in p
    assert "partial_sum" in p
    assert "BroadcastExchange" in p  # nation (fixed 25 rows) at least


def test_window_block_single_exchange(spark):
    from mensura.operators.windows import build_targets
    d = build_targets(panels.rev_panel_dense(spark, SF))
    p = plan(d)
    # lineitem->order, panel groupBy, one series exchange for every window
    assert p.count("Exchange hashpartitioning(series_id") == 1


def test_hot_key_gram_is_exact(spark):
    """One key holds a third of the rows: the Gram aggregation still equals
    the direct computation (it is partial, so the hot key is combined
    map-side before the shuffle)."""
    rng = np.random.default_rng(9)
    n = 3000
    keys = np.where(np.arange(n) < n // 3, "hot", np.char.add("k", (np.arange(n) % 50).astype(str)))
    X = rng.normal(size=(n, 3))
    y = X @ [1.0, -1.0, 2.0] + rng.normal(size=n)
    rows = [(str(k), [float(v) for v in x], float(t)) for k, x, t in zip(keys, X, y)]
    df = spark.createDataFrame(rows, "series_id string, x array<double>, y double").repartition(8)
    g = lin.gram(df, ["series_id"], p=3)
    assert "partial" in plan(g).lower()
    hot = np.array(g.filter("series_id = 'hot'").first().gram)
    m = keys == "hot"
    z = np.column_stack([np.ones(m.sum()), X[m], y[m]])
    full = z.T @ z
    assert np.allclose(hot, full[np.triu_indices(5)], rtol=1e-10)


def test_supplier_panel_with_hot_supplier_matches_pandas(spark, tmp_path):
    """One supplier holds a third of all lines: the panel (one partially
    aggregated groupBy) still equals a direct pandas computation."""
    import datetime as dt

    import pandas as pd

    rng = np.random.default_rng(14)
    n = 6000
    supp = np.where(np.arange(n) % 3 == 0, 7, rng.integers(0, 40, n))
    ship = [dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 365, n)]
    pdf = pd.DataFrame({"l_suppkey": supp.astype("int64"), "l_shipdate": ship,
                        "l_extendedprice": np.round(rng.uniform(1, 1000, n), 2),
                        "l_discount": np.round(rng.integers(0, 11, n) / 100, 2),
                        "l_quantity": rng.integers(1, 50, n).astype(float),
                        "l_tax": np.round(rng.integers(0, 9, n) / 100, 2)})
    spark.createDataFrame(pdf).repartition(8).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.series_id, r.period): (r.target, r.n_lines)
           for r in panels.supplier_panel(spark, str(tmp_path)).collect()}
    pdf["period"] = pdf.l_shipdate.dt.to_period("M").dt.to_timestamp().dt.date
    pdf["rev_cents"] = (np.round(pdf.l_extendedprice * 100).astype("int64")
                        * (100 - np.round(pdf.l_discount * 100).astype("int64")))
    want = pdf.groupby(["l_suppkey", "period"]).agg(rev=("rev_cents", "sum"), n=("rev_cents", "size"))
    assert len(got) == len(want)
    for (s, p), row in want.iterrows():
        target, n_lines = got[(str(s), p)]
        assert n_lines == row.n
        assert target == pytest.approx(row.rev / 10000, abs=0.006)
    assert sum(v[1] for k, v in got.items() if k[0] == "7") >= n // 3
