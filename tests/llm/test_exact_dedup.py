import hashlib
import random

from millrace.llm import exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "A", "Ä", "ä", "x" * 60000, "x" * 59999 + "X", "b c", "B C ", "ẞ", "ß"]
    rows = [(i, rng.choice(texts)) for i in range(200)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = {i: (max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows}
    got = exact_dedup.op3_exact_dedup(spark, docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)


def test_kept_documents_with_clashing_columns(spark):
    rows = [(1, "a", 7, "p", "u"), (2, "A", 8, "q", "v"), (2, "A", 8, "q", "v"), (3, None, 9, "r", "w"), (3, "", 9, "r", "w"), (4, "b", 1, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest int, __tag string, `di gest.x` string")
    out = exact_dedup.kept_documents(docs, exact_dedup.fresh_index(spark))
    assert out.columns == docs.columns
    kept = sorted(tuple(r)[:1] + tuple(r)[2:] for r in out.collect())
    assert kept == [(2, 8, "q", "v"), (3, 9, "r", "w"), (4, 1, "s", "x")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.op3_exact_dedup(spark, docs).count() == 0
    assert exact_dedup.kept_documents(docs, exact_dedup.fresh_index(spark)).count() == 0


def decided(df):
    return sorted((r.doc_id, r.keep_id, r.kept) for r in df.collect())


def test_query_goes_through_an_index_that_it_drops(spark, monkeypatch):
    reads = []
    read = exact_dedup.DigestIndex.read
    monkeypatch.setattr(exact_dedup.DigestIndex, "read", lambda self: reads.append(self.name) or read(self))
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "doc_id long, text string")
    assert decided(exact_dedup.op3_exact_dedup(spark, docs)) == [(1, 2, False), (2, 2, True), (3, 3, True)]
    assert len(reads) == 2 and not spark.catalog.tableExists(reads[0])


def test_index_is_reopened_under_other_settings_and_batches_run_again(spark):
    index = exact_dedup.fresh_index(spark)
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    assert decided(exact_dedup.dedup(batch((1, "a"), (2, "b")), index, batch="one")) == [(1, 1, True), (2, 2, True)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, index.name)
        second = batch((3, "A"), (4, "c"), (5, "c"))
        want = [(3, 1, False), (4, 5, False), (5, 5, True)]
        assert decided(exact_dedup.dedup(second, again, batch="two")) == want
        # As after a failure that came behind the append.
        assert decided(exact_dedup.dedup(second, again, batch="two")) == want
        assert again.read().count() == 3 and again.bucket_count() == int(before)
        other = spark.range(9).select(exact_dedup.F.unhex(exact_dedup.F.sha2(exact_dedup.F.col("id").cast("string"), 256)).alias("digest"))
        plan = other.hint("merge").join(again.read(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # the index isn't shuffled
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    index.drop()
