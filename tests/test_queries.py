"""Registered queries against their DuckDB equivalents on the smallest tables."""

import duckdb
import numpy as np
import pytest

from spanloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver compares all of them.
SAMPLE = ["d13_strict_eval", "c6_overlap_join", "d15_any_overlap", "h_validation", "f1_bio_encode", "g10_three_sets", "c14_top_k_blocked", "d23_roc_auc", "b22_b24_rules", "d26_reciprocal_frequency"]


def normal(df):
    df = df[sorted(df.columns)]
    rows = [tuple("~" if v is None or (isinstance(v, float) and np.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert normal(registry.queries()[name](spark, sf).toPandas()) == normal(con.sql(registry.oracle_sql()[name]).df())


def test_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_matchings_are_ordered(spark, sf):
    q = registry.queries()
    best, greedy, loose = (q[n](spark, sf).first() for n in ("d14_optimal_matching", "d16_greedy_matching", "d15_any_overlap"))
    strict = q["d13_strict_eval"](spark, sf).where("type = 'Total'").first()
    assert strict["tp"] <= greedy["tp"] <= best["tp"] <= min(loose["tp_ref"], loose["tp_pred"])


def test_entry_without_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    sys.modules.pop("__spark_entry__", None)
