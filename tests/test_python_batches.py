"""Python works on a hundred rows at a time, so a worker's memory doesn't grow with its partition."""

import pytest
from pyspark.sql import functions as F

from lectern.plans import queries


def planned(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["s02_html", "p03_row_options", "c09_reflow", "n10_parentheses", "d02_denoise"])
def test_texts(spark, sf, name):
    plan = planned(spark, sf, name)
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_books(spark, sf):
    from lectern.plans.job_queries import _books
    from lectern.sources import extract

    plan = _books(spark, sf).select(extract.html_text(extract.decode(F.col("content"))))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
