import math

import pytest

from tidemark import WindowAggregation, summarize
from tidemark.functions.measures import expected_reduction_factor, reduction_factor, standard_error


def test_documented_example():
    assert expected_reduction_factor(10, 50, 5) == 100


def test_measures(messages):
    rows = [(w * 10 + i / 50, float(i)) for w in range(3) for i in range(500)]
    window = WindowAggregation(
        window_size_seconds=10, operations=("min", "mean", "median", "stdev", "max")
    )
    summary = summarize(messages(rows, "value double"), window)
    assert reduction_factor(summary, 5).collect()[0]["reduction_factor"] == 100.0
    row = summary.select("stdev_value", standard_error("value").alias("se")).first()
    assert row["se"] == pytest.approx(row["stdev_value"] / math.sqrt(500))
    with pytest.raises(ValueError):
        reduction_factor(summary, 0)
