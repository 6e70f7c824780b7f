"""Driver contract and SQL twins at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

TABLES = ["lineitem", "orders", "embeddings"]
FAST = ["track_join", "year_join", "subset_counts", "subset_label_counts", "text_inputs_join",
        "assembled_features", "label_index", "feature_categories", "indexed_features",
        "label_decode_roundtrip", "key_split", "fold_counts", "logreg_default_predictions",
        "accuracy_test_error", "sample_predictions", "embedding_logreg_accuracy", "ols_year",
        "regression_metrics", "tree_depth2", "tree_cv",
        "quarantined_rows"]
# logreg_cv_grid's twin assumes every grid point keeps zero coefficients on every
# fold; that holds at sf0.01 (the driver's check) but not at sf0.001 for
# regParam 0.1 / elasticNet 0.2, so it is not compared here.  The CV metric
# itself is checked against a per-fold recomputation in test_tuning.py.


def test_contract_shapes():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 30


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "n_rows", "n_correct", "accuracy"]
    assert df.count() == 5


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _canon(pdf):
    cols = sorted(pdf.columns)
    out = []
    for row in pdf[cols].itertuples(index=False):
        out.append(tuple(round(v, 9) if isinstance(v, float) else
                         (v.item() if hasattr(v, "item") else v) for v in row))
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("name", FAST)
def test_twin_matches(spark, con, name):
    spark_cols, spark_rows = _canon(E.queries()[name](spark, SF_SMALL).toPandas())
    sql_cols, sql_rows = _canon(con.execute(E.oracle_sql()[name]).df())
    assert spark_cols == sql_cols
    assert spark_rows == sql_rows


def test_every_query_documented():
    import os
    readme = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "README.md")).read()
    missing = [name for name in E.queries() if f"`{name}`" not in readme]
    assert not missing, missing


@pytest.mark.parametrize("blocked", ["trackml.llm", "corpus_pipeline", "ahocorasick", "tokenizers"])
def test_entry_without_the_optional_part(blocked):
    """Whatever the operators cannot import, the other queries stay."""
    import subprocess
    import sys

    code = (f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as E; "
            "assert 'track_join' in E.queries() and len(E.queries()) >= 38; "
            "print('op8_repeats' in E.queries(), set(E.oracle_sql()) <= set(E.queries()))")
    root = __import__("os").path.dirname(E.__file__)
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    has, whole = out.stdout.split()
    assert whole == "True" and (has == "False" or blocked == "tokenizers")
