import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import similarity
from millrace.llm.simhash import fingerprint_table, hash_array, shingle_hashes


def jaccard(a, b):
    return len(a & b) / len(a | b)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def linked(named):
    """Bands by the operator's own pass, then all links."""
    bands = fingerprint_table(named, "node", "text", 5, True)
    bands = bands.select(F.col("doc_id").alias("node"), "bands")
    return [(r.a, r.b) for r in similarity.similar_links(named, bands, 5, 0.8, hash_array).collect()]


def texts_that_share(seed):
    """Groups whose members share bands with many that aren't similar, chains of similar texts, and copies of one text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(160)]
    out = [[*passage, *(word() for _ in range(rng.randint(10, 90)))] for _ in range(80)]
    for start in range(12):
        chain = [word() for _ in range(100)] if start % 2 else [*passage, *(word() for _ in range(20))]
        for _ in range(8):
            chain = [*chain[6:], *(word() for _ in range(6))]
            out.append(chain)
    return [" ".join(x) for x in [*out, *out[:5]]] + ["", "one", "one", "a b"]


def test_components_match_all_pairs(spark):
    for seed in (1, 2):
        texts = texts_that_share(seed)
        ids = {t: k for k, t in enumerate(sorted(set(texts)))}
        named = spark.createDataFrame([(ids[t], t) for t in texts], "node long, text string").repartition(4)
        got = linked(named)
        sets = {k: set(shingle_hashes(t.encode(), 5)) for t, k in ids.items()}
        want = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
        assert want and all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)
        assert roots(sets, got) == roots(sets, want)


def test_no_rows(spark):
    assert linked(spark.createDataFrame([], "node long, text string")) == []


def test_sketch_places_follow_similarity():
    rng = np.random.default_rng(3)
    most, half = similarity.most_sketch_places(0.8), similarity.SKETCH_WORDS
    for _ in range(60):
        common, own = rng.integers(0, 1 << 63, 400, np.uint64), rng.integers(0, 1 << 63, 300, np.uint64)
        a, b, c = np.concatenate([common, own[:50]]), np.concatenate([common, own[50:100]]), np.concatenate([common, own[100:]])
        far = rng.integers(0, 1 << 63, 450, np.uint64)
        odd = similarity.sketches([a, b, c, far])[:, None] ^ similarity.sketches([a, b, c, far])[None]
        x = np.bitwise_count(odd[..., :half] | odd[..., half:]).sum(axis=2)
        assert x[0, 1] <= most and min(x[0, 2], x[0, 3], x[1, 3]) > most  # 0.8 against 0.62 and none


def test_members_meet_once_and_repeated_and_null_texts(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(120))
    rows = [(1, text), (1, text), (2, text + " tail"), (3, None), (4, ""), (5, text.replace(" ", "\n"))]
    got = linked(spark.createDataFrame(rows, "node long, text string"))
    assert roots([1, 2, 3, 4, 5], got) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
