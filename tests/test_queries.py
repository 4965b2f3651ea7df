"""Ledger and inference queries against their SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import inference_queries, ledger_queries

TABLES = "/root/testdata/sf0.001"
NAMES = ["ledger_summary", "ledger_family_marginal", "ledger_family_convergence", "ledger_deepen_queue", "ledger_graph_families", "ledger_reconcile", "ledger_follow_rate", "ledger_rescue_cards", "tail_metrics", "selection_pairs", "regime_ic", "carving", "causality"]


def rows(df):
    show = lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else f"{float(v) + 0:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    found = {**ledger_queries.QUERIES, **inference_queries.QUERIES}[name](spark, TABLES).toPandas()
    db = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        db.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    want = db.sql({**ledger_queries.ORACLES, **inference_queries.ORACLES}[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)
