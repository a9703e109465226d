"""A keyed table reads a batch's rows once."""

from millrace.sources.sinks import UpsertTable


def test_an_addition_reads_its_rows_once(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            met.add(len(f))
            yield f

    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    rows = spark.range(1000).selectExpr("id % 7 AS k", "1L AS ct")
    for n in range(2):
        table.add(rows.mapInPandas(counted, rows.schema), ["ct"], n)
        assert met.value == 1000 * (n + 1)
    assert {r.k: r.ct for r in table.read().collect()} == {k: 2 * len(range(k, 1000, 7)) for k in range(7)}
