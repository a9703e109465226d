"""Parts of topics."""

from pyspark.sql import functions as F

from millrace.plans.feeds import Fed
from millrace.plans.samples import Samples
from millrace.sources import files
from millrace.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_parts_are_several_files_and_batches_are_whole_parts(spark):
    t = Fed(Samples(spark, SMALL))
    rows = spark.range(100).select(F.col("id").alias("ts"), F.col("id").alias("arrival"), (F.col("id") % 2).alias("k"))
    t.put_parts(rows, "parts", F.when(F.col("ts") == 7, 1).when(F.col("ts") > 50, 2).otherwise(0), 3)
    assert sum(n.startswith("part-") for n in files.names(spark, f"{t.root}/parts")) == 3 * t.cores() and t.cores() > 1
    sizes = []

    def job(spark, root, available_now):
        return jobs.run_stream(jobs.read_topic(spark, root, "parts", True), lambda batch, number: sizes.append(batch.count()), f"{root}/_checkpoints/parts", available_now=available_now)

    t.run(job)
    assert sizes == [50, 1, 49]
