"""Inputs that used to lose rows: part files, NULL groups, NaN values."""

import math

from swathline.functions.ranking import exact_percentiles, rank_in_group
from swathline.session import scratch_path
from swathline.streaming.jobs import append_ingest, stream_table


def test_stream_reads_a_folder_of_part_files_in_several_batches(spark):
    folder, out = scratch_path(spark, "parts"), scratch_path(spark, "out")
    rows = spark.range(1000).selectExpr("id", "id % 3 AS k").repartition(4)
    rows.write.parquet(f"{folder}/events.parquet")
    stream = stream_table(spark, folder, "events", files_per_batch=1)
    append_ingest(stream, out, scratch_path(spark, "check"), "k")
    assert spark.read.parquet(out).count() == 1000


def test_ranks_keep_null_groups(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, k long")
    assert sorted((r.g or "", r.rank) for r in rank_in_group(frame, "g", "k").collect()) == [("", 0), ("", 1), ("a", 0), ("a", 1)]


def test_percentiles_skip_nan(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (math.nan,), (None,)], "v double")
    (row,) = exact_percentiles(frame, "v", [0.5, 1.0]).collect()
    assert tuple(row) == (2.0, 3.0)
