"""Scores to the last bit: what ties in whole hundredths ties in scores, so peaks don't depend on rounding."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from weftline.functions.features import expressions
from weftline.operators.quality import Grid, Sweep, size_fitness


def test_compactness_is_the_nearest_double(spark):
    e = expressions()
    rows = spark.range(300).select(F.col("id").alias("n"), *(F.col("id").cast("int").alias(c) for c in ("input_symbol_count", "output_symbol_count", "cross_symbol_count")))
    got = rows.select("n", e["input_interface_compactness"].alias("i"), e["output_interface_compactness"].alias("o"), e["interface_compactness"].alias("c")).collect()
    for n, i, o, c in got:
        assert i == o == 1.0 / float(1 + Decimal("0.35") * n)
        assert c == 1.0 / float(1 + Decimal("0.45") * n)


def test_quality_of_intervals_is_the_same_everywhere(spark):
    fit = spark.range(1, 400).select("id", size_fitness(F.col("id")).alias("fit")).where("id > 40").collect()
    assert all(f == 1.0 / float(1 + Decimal("0.002") * (n - 40)) for n, f in fit)
    n = 9
    edges = [(a, b, "DATA", f"s{a}{b}") for a in range(4) for b in range(5, n)]
    uses = sorted({(x, s) for a, b, _, s in edges for x in (a, b)})
    given = (n, edges, uses, np.zeros(n, bool), np.zeros(n))
    grid = Grid(*given)
    for e, m, c in Sweep(*given, list(range(n))).scored(list(range(n))):
        assert (c["score"] == grid.scores()[:m, e]).all()
    s, e = np.triu_indices(n)
    want = [1.0 / float(1 + Decimal("0.35") * int(grid.inputs[i, j] + grid.outputs[i, j])) for i, j in zip(s, e)]
    assert (grid.features()["external_compactness"][s, e] == want).all()
