"""The rows of a bucket meet once, and new rows are worked out once."""

from pyspark.sql import functions as F

from lectern.operators import commits


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_merge_shuffles_once_and_leaves_nothing_beside(spark, tmp_path):
    table = commits.Table(spark, str(tmp_path))
    made = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(40).select((F.col("id") % 20).alias("k"), F.col("id").alias("v")).mapInPandas(work, "k long, v long")
    table.merge(rows, ["k"], order="v", source="s", batch=0)
    assert made.value == 40 and table.read().count() == 20 and table.read().agg(F.min("v")).first()[0] == 20
    table.merge(rows.where("k < 5"), ["k"], order="v", source="s", batch=1)
    assert made.value == 80 and table.read().count() == 20
    assert table.merge(rows, ["k"], order="v", source="s", batch=1) is None and made.value == 80
    now = table.version()
    assert exchanges(table._merged(spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v")), ["k"], None, now, now.buckets)) == 1
    assert {p.name for p in (tmp_path / "data").iterdir()} == {f.split("/")[1] for v in table.versions() for fs in table.version(v).folders.values() for f in fs}
