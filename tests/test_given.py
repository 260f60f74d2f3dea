"""Models from given parameters: values against SQL, against plain Python and through save and load."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from voxlab.operators.given import estimated_ensemble, given_linear, given_logistic
from voxlab.operators.project import assemble
from voxlab.operators.treeshap import tree_attribution
from voxlab.plans.given import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF).toPandas()[list(want.columns)]
    keys = [c for c in want.columns if want[c].dtype != float]
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    for c in want.columns:
        if want[c].dtype == float:
            np.testing.assert_allclose(got[c], want[c], atol=2e-6)
        else:
            assert got[c].tolist() == want[c].tolist()


TREE = ("x", 1.5, ("y", 0.5, None, None), None)


def test_node_statistics_of_a_small_table(spark):
    rows = [(0, 1.0, 0.0, 4.0), (1, 1.0, 1.0, 2.0), (2, 2.0, 0.0, 1.0), (3, None, 0.0, 3.0), (4, float("nan"), 9.0, 5.0), (5, 1.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, t double")
    model = estimated_ensemble(df, ["x", "y"], "t", [TREE, None])
    got = {r.id: r.prediction for r in model.transform(assemble(df, ["x", "y"], "features")).collect()}
    # null and NaN go right, where the mean is that of 1, 3 and 5; the second tree is the mean of all
    assert got == pytest.approx({0: (4 + 3) / 2, 1: (2 + 3) / 2, 2: 3.0, 3: 3.0, 4: 3.0, 5: (4 + 3) / 2})
    att = tree_attribution(df.where("x is not null and not isnan(x)"), "id", ["x", "y"], model).collect()
    for i in (0, 1, 2):
        own = [r for r in att if r.id == i]
        assert sum(r.value for r in own) + own[0].base_value == pytest.approx(got[i])


def test_empty_table_and_empty_nodes(spark):
    schema = "id long, x double, y double, t double"
    row = spark.createDataFrame([(1, 1.0, 0.0, 2.0)], schema)
    assert assemble(row, ["x", "y"], "features").transform(
        estimated_ensemble(spark.createDataFrame([], schema), ["x", "y"], "t", [TREE]).transform).first().prediction == 0.0
    one = estimated_ensemble(row, ["x", "y"], "t", [TREE])
    other = spark.createDataFrame([(2, 9.0, 0.0, 0.0)], schema)
    assert one.transform(assemble(other, ["x", "y"], "features")).first().prediction == 2.0  # a node without rows: its parent's mean


def test_given_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
    df = spark.createDataFrame([(float(i % 3), float(i % 2), float(i)) for i in range(12)], "x double, y double, t double")
    v = assemble(df, ["x", "y"], "features")
    for kind, model in [(LogisticRegressionModel, given_logistic(spark, [1, -2], 0.5)), (LinearRegressionModel, given_linear(spark, [1, -2], 0.5)),
                        (GBTRegressionModel, estimated_ensemble(df, ["x", "y"], "t", [TREE]))]:
        model.write().save(str(tmp_path / kind.__name__))
        back = kind.load(str(tmp_path / kind.__name__))
        assert [r.prediction for r in back.transform(v).collect()] == [r.prediction for r in model.transform(v).collect()]
