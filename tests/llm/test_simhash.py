import random
import re

import xxhash

from millrace.llm import simhash


def brute(rows, width=3, distance=2):
    """Fingerprints by the definition, links over all pairs, components by flooding."""
    fps = {}
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    comp = {}
    for start in sorted(fps):
        if start in comp:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = start
                todo += [y for y in fps if y not in comp and (fps[x] ^ fps[y]).bit_count() <= distance]
    return {d: (f"{fps[d]:016x}", comp[d]) for d in fps}


def near_texts(seed, n=150):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["Ünï", "ABC", "ß"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 200]))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "x" * 50000)]
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(words)))
    return rows


def test_matches_brute_force(spark):
    rows = near_texts(1)
    got = simhash.op5_simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == brute(rows)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(12):
            f ^= (1 << rng.randrange(64)) * rng.randint(0, 1)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for distance in (1, 2, 3):
        got = simhash.near_links(spark.createDataFrame(signed, "fp long"), distance).collect()
        want = {frozenset((a[0], b[0])) for a in signed for b in signed if a[0] < b[0] and ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count() <= distance}
        assert {frozenset(x) for x in got} == want and len(got) == len(want)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, key int")
    assert simhash.op5_simhash_near_dedup(spark, empty).count() == 0
    odd = spark.createDataFrame([(None, "a b", "x", 1), (3, "a b", "y", 2), (3, "a b", "y", 2)], "doc_id long, text string, fp string, key int")
    assert [r.component_id for r in simhash.op5_simhash_near_dedup(spark, odd).collect()] == [3, 3, 3]
