"""Small cases for findings of round 3 about growth: what a step makes or holds, with the same results."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T
from pyspark.sql.classic.dataframe import DataFrame

from ticketlens.llm import neardup
from ticketlens.operators import classify as c
from ticketlens.operators import linear
from ticketlens.streaming import jobs


def test_members_of_a_list_meet_in_few_blocks(spark):
    """op2, pipeline: every member of a large list is a row once per block, so blocks must be large."""
    rows = spark.range(900).selectExpr("7L AS value", "id AS cid", "100L AS n", "100L AS shared",
                                       "id AS comp")
    met = neardup._meetings(rows, 80)
    assert met.count() == 900 and met.select("cid").distinct().count() == 900


def test_row_form_of_the_regression_equals_the_library(spark):
    """coefficients from one number per row and class are those of the library."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(80, 12)) * (rng.random((80, 12)) < 0.5), rng.integers(0, 3, 80)
    x[:, 0] += y
    weight = (80 / (3 * np.bincount(y)))[y]
    alpha, intercepts = linear.regress(lambda r: x @ (x.T @ r), y, weight, 3, 1 / (4.0 * 80), 500, 1e-12)
    rows = spark.createDataFrame([(Vectors.dense(v), float(k), float(w)) for v, k, w in zip(x, y, weight)],
                                 T.StructType([T.StructField("features", VectorUDT()),
                                               T.StructField("label", T.DoubleType()),
                                               T.StructField("w", T.DoubleType())]))
    fitted = LogisticRegression(family="multinomial", standardization=False, regParam=1 / (4.0 * 80),
                                weightCol="w", maxIter=500, tol=1e-12).fit(rows)
    expected = fitted.coefficientMatrix.toArray()
    got = (x.T @ alpha).T
    assert np.allclose(got - got.mean(axis=0), expected - expected.mean(axis=0), atol=1e-4)
    assert np.allclose(intercepts, fitted.interceptVector.toArray(), atol=1e-4)


@pytest.mark.parametrize("model", ["bayes", "logistic"])
def test_the_driver_holds_no_vocabulary(spark, monkeypatch, model):
    """What reaches the driver grows with the rows of the fit, not with their terms."""
    rows = spark.range(40).selectExpr(
        "id AS ticket_id", "concat('w', id div 2, ' v', id div 4, ' u', id % 8, ' t', id % 5) AS text",
        "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS category")
    taken, take, collect = [], DataFrame.toPandas, DataFrame.collect

    def counted(f):
        def run(self):
            out = f(self)
            taken.append(len(out))
            return out
        return run

    monkeypatch.setattr(DataFrame, "toPandas", counted(take))
    monkeypatch.setattr(DataFrame, "collect", counted(collect))
    model = c.fit_classifier(rows, "category", model, max_iter=5)
    assert max(taken) <= 40
    monkeypatch.undo()
    assert model.transform(rows).filter("confidence BETWEEN 0.5 AND 1").count() == 40


def test_a_stream_of_texts_is_classified_batch_by_batch(spark, tmp_path):
    """the row form of the models reads batch rows, which a stream hands over."""
    train = spark.range(24).selectExpr(
        "id AS ticket_id", "if(id % 2 = 0, 'fatura cobrada', 'pedido atrasado') AS text",
        "if(id % 2 = 0, 'a', 'b') AS category", "if(id % 2 = 0, 'low', 'high') AS priority",
        "'gold' AS tier", "'chat' AS channel")
    models = c.fit_classifier(train, "category", "bayes"), c.fit_priority(train, max_iter=3)
    train.select("ticket_id", "text").coalesce(2).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("ticket_id long, text string").parquet(f"{tmp_path}/in")
    jobs.triage_stream(rows, *models, f"{tmp_path}/out", once=True).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("ticket_id").distinct().count() == 24
    assert out.filter("category = 'a' AND ticket_id % 2 = 0 OR category = 'b' AND ticket_id % 2 = 1").count() == 24
