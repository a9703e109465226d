"""How many files a topic has doesn't matter."""

from pyspark.sql import functions as F

from millrace.plans.samples import Samples
from millrace.plans.streams import LAST, Topics
from millrace.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_files_of_a_topic_beyond_the_bound_of_a_batch_are_not_late(spark):
    t = Topics(Samples(spark, SMALL))
    topic = f"{t.root}/{jobs.TOPICS['page']}"
    pages = t.s.pages.select(F.create_map(F.lit("mid"), "mid").alias("common"), F.create_map(F.lit("page_id"), F.lit("good_list"), F.lit("item"), F.lit("ring")).alias("page"), "ts")
    for low, high in ((1, 10), (0, 1)):  # in more files than a batch has otherwise, not in order of time
        days = F.col("ts") % 10
        jobs.as_json(pages.filter((days >= low) & (days < high)).repartition(70)).write.mode("append").text(topic)
    jobs.as_json(t.closing()).write.mode("append").text(topic)
    t.run(jobs.keep_keyword_stats, "1 day")
    assert t.table("keyword").filter(F.col("keyword") != LAST).agg(F.sum("ct")).first()[0] == pages.count()
