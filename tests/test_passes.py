"""Work that is done once, however many passes follow."""

from pyspark.sql import functions as F

from swathline.operators import ml


def test_training_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(n):
        made.add(1)
        return float(n % 7)

    rows = spark.range(200).select((F.col("id") % 2).cast("int").alias("label"), value("id").alias("a"))
    model = ml.train_forest(rows, ["a"], trees=2, depth=2)
    assert model.stages[-1].getNumTrees == 2
    assert made.value == 200
