import math
import re
from itertools import permutations

from pyspark.sql import functions as F

from millrace.llm import filter_audit as fa

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """By definition: every order on every document."""
    least, parts = {}, {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if doc_id is not None and doc_id > least[t] else set()
        parts.setdefault(source or "", []).append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                failing = sum(f in r[0] for r in rows)
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def results(spark, docs, labels):
    return found(fa.audit(fa.masks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))))


def test_against_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(300))
    texts = [None, "", " \x0b\n", "a b", "A" * 3, "x#y", long, long.upper(), "the cat " * 150, f"{long} 5%", long + "\xa0\x85 é 日", "a" * 60_000, "word " * 100_000]
    docs = [(k, texts[k * 7 % len(texts)], ["s", None, "", "t"][k % 4]) for k in range(80)] + [(None, "a b", "s"), (5, "a b", "u"), (5, "a b", "u"), (-3, long, "u")]
    labels = [(k, k % 3 == 0, k % 5 == 0) for k in range(0, 80, 2)] + [(0, None, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    labels = [(d, q if q is None else int(q), t if t is None else int(t)) for d, q, t in labels]
    assert results(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    assert results(spark, [], []) == {}
    docs = [(1, "a", "s"), (2, "a", "s")]
    assert results(spark, docs, []) == brute(docs, [])
    more = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("part", "mask", "digest", "labelled", "good", "least")})
    assert found(fa.audit(fa.masks(more, spark.createDataFrame([(1, 1, 0)], LABELS).withColumn("part", F.lit(2))))) == brute(docs, [(1, 1, 0)])


def test_walk_by_adjacent_transpositions():
    orders = list(fa.adjacent_orders(5))
    assert len({tuple(o) for o, _ in orders}) == math.factorial(5)
    for (one, _), (two, k) in zip(orders, orders[1:], strict=False):
        swapped = one[:k] + [one[k + 1], one[k]] + one[k + 2 :]
        assert swapped == two
