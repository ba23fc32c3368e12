"""Small cases for the findings of round 3 about folds and the latent space: what a step writes or asks for."""

import os

import numpy as np

from ticketlens.operators import classify as c
from ticketlens.operators import linear
from ticketlens.session import shared_folder


def _tables(spark):
    folder = f"{shared_folder(spark).removeprefix('file://')}/ticketlens"
    return {f"{folder}/{name}" for name in (os.listdir(folder) if os.path.isdir(folder) else [])}


def test_folds_write_no_term_rows(spark):
    """F8: what cross-validation writes is far less than a row per text and term."""
    rows = spark.range(40).selectExpr(
        "id AS ticket_id", "concat_ws(' ', transform(sequence(0, 59), x -> concat('w', (x + id) % 60))) AS text",
        "if(id % 2 = 0, 'a', 'b') AS category")
    before = _tables(spark)
    scores = c.cross_validate(rows, "category", "ticket_id", ["bayes"]).collect()
    assert len(scores) == 5
    written = {path: spark.read.parquet(path).count() for path in _tables(spark) - before}
    assert written and max(written.values()) < 40 * 60, written


def test_regressions_of_all_folds_share_their_products():
    """a product serves every fit that still runs, and each ends as it would alone."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(60, 9)), rng.integers(0, 3, 60)
    weights = [np.where(np.arange(60) % 3 == i, 0.0, 1.0) for i in range(3)]
    asked, calls = [], []

    def products(some):
        asked.append(len(some))
        return {i: x @ (x.T @ r) for i, r in some.items()}

    fits = [linear.regression(y, w, 3, 0.01, 40, 1e-6) for w in weights]
    together = linear.regress_together(products, fits)
    for w, (alpha, margins, intercepts) in zip(weights, together):
        assert not alpha[w == 0].any() and np.allclose(margins, x @ (x.T @ alpha))

        def alone(r):
            calls.append(1)
            return x @ (x.T @ r)

        expected = linear.regress(alone, y, w, 3, 0.01, 40, 1e-6)
        assert np.allclose(alpha, expected[0]) and np.allclose(intercepts, expected[1])
    assert asked[0] == 3 and sum(asked) == len(calls) and len(asked) < len(calls)
