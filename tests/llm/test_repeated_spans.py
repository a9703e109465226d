import hashlib
import random
from collections import Counter

from millrace.llm import repeated_spans


def brute(rows, width):
    seen = Counter(t[i : i + width] for _, t in rows for i in range(len(t) - width + 1))
    out = []
    for doc_id, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé fgh ") for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 400, 900)]
    rows = []
    for d in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [s[a : a + rng.randint(150, 900)], text(rng.randint(0, 200))]
        rows.append((d, "".join(parts)))
    rows += [(100, "ab" * 400), (101, "x" * 1000), (102, "y" * 200), (103, "y" * 200), (104, "z" * 200), (105, rows[3][1]), (106, rows[3][1][:-1] + "!"), (107, None), (108, "")]
    return rows + [(109, (shared[5] + text(30)) * 3), (109, rows[5][1]), (None, rows[7][1]), (200, rows[9][1]), (200, rows[9][1])]


def test_matches_brute_force(spark):
    rows = case(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in repeated_spans.op9_repeated_spans(spark, docs).collect()), key=repr)
    assert got == brute([(d, (t or "").encode()) for d, t in rows], 200)
    assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


def test_edges(spark):
    schema = "doc_id long, text string, anchor int, tag string"
    assert repeated_spans.op9_repeated_spans(spark, spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, "q" * 300 + "é", 1, "x"), (2, "short", 1, "x")], schema)
    kept = {r.doc_id: bytes(r.kept).decode() for r in repeated_spans.remove_repeats(same).collect()}
    assert kept == {1: "é", 2: "short"}


def test_long_text_in_pieces_and_shards_on_disk(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long = text(2_300_000)
    rows = [(1, long), (2, text(500) + long[999_700:1_000_300] + text(500)), (3, long[1_999_900:2_000_150]), (4, text(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeated_spans.op9_repeated_spans(spark, docs).collect()}
    assert got == {1: (2_300_000, 850, 2), 2: (1600, 600, 1), 3: (250, 250, 1), 4: (400, 0, 0)}


def test_shard_on_disk_is_the_same():
    import pyarrow as pa

    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(40)) for _ in range(12)]
    bodies = ["".join(rng.choice(words) for _ in range(7)).encode() for _ in range(60)] + [bytes([255, 254]) * 130]
    batch = pa.RecordBatch.from_pydict({"anchor": list(range(61)), "context": [0] * 61, "windows": pa.array([len(b) - 199 for b in bodies], pa.int32()), "several": [k == 3 for k in range(61)], "body": pa.array(bodies, pa.binary())})
    out = []
    for room in (1 << 30, 1000):
        shard = repeated_spans.Shard(room)
        shard.add(batch.slice(0, 30))
        shard.add(batch.slice(30))
        out.append([r for part in shard.repeats(200, 7) for r in part.to_pylist()])
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    want = {k: {i for i in range(len(b) - 199) if k == 3 or seen[b[i : i + 200]] > 1} for k, b in enumerate(bodies)}
    assert out[0] == out[1]
    assert {r["anchor_"]: {i for x in r["ranges"] for i in range(x["s"], x["e"])} for r in out[0]} == {k: v for k, v in want.items() if v}


def test_clashing_names(spark):
    rows = [(1, "k" * 250, 1, "a", 5), (2, "k" * 250, 2, "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor_ int, tag string, context long")
    assert [r.n_removed for r in repeated_spans.op9_repeated_spans(spark, docs).collect()] == [250, 250]


def test_recursion_and_disk_through_the_query(spark):
    rows = case(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # One shard or few; tasks hold next to nothing and recurse to the last name.
    got = repeated_spans.remove_repeats(docs, digest=True, shard_bytes=1 << 30, room=500, base=1)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in got.collect()), key=repr)
    assert got == brute([(d, (t or "").encode()) for d, t in rows], 200)
