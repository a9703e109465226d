import random
import zlib
from collections import defaultdict

from millrace.llm import sharding


def naive_best_fit(sizes, capacity):
    free, out = [], []
    for s, n in sizes:
        for _ in range(n):
            fits = [(r, b) for b, r in enumerate(free) if r >= s]
            if fits:
                b = min(fits)[1]
            else:
                b = len(free)
                free.append(max(capacity, s))
            free[b] -= s
            out.append(b)
    return out, len(free)


def test_best_fit_as_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        sizes = sorted({rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 15))}.items(), reverse=True)
        placed, used = sharding.best_fit(sizes, 70)
        assert ([b for k, b in placed for _ in range(k)], used) == naive_best_fit(sizes, 70)


def test_even_shards(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 5, 50, 400]))) for _ in range(400)]
    rows = [(i, rng.choice(texts)) for i in range(3000)] + [(5000, None), (5001, ""), (5001, ""), (None, "x" * 3000)]
    out = sharding.op6_sharding(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.shard for r in out} == set(range(8))
    by_id, load, slots, crcs = dict(rows), defaultdict(int), defaultdict(list), defaultdict(set)
    for r in out:
        text = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        crcs[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in crcs.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())


def test_hot_group_and_edges(spark):
    rows = [(i, "hot " * 50) for i in range(300)] + [(1000 + i, f"text {i}") for i in range(800)]
    load = defaultdict(int)
    for r in sharding.op6_sharding(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        load[r.shard] += r.size
    rest = sorted(load.values())[:-1]
    assert len(load) == 8 and max(load.values()) == 300 * 201 and max(rest) - min(rest) < 20
    assert sharding.op6_sharding(spark, spark.createDataFrame([], "doc_id long, text string, shard int")).count() == 0
    docs = spark.createDataFrame([(i, "x" * i, "c") for i in range(50)], "doc_id long, text string, shard string")
    fixed = sharding.shard_fixed(docs, 60).groupBy("shard").sum("size").collect()
    assert all(r[1] <= 60 for r in fixed) and len(fixed) <= 27
