import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import spelling_variants as sv

ROOT = "/root/testdata/sf0.001"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def grouped(n):
    """By definition, on all pairs."""
    out = {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, None, n[w], len(close), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_vocabulary_and_groups_against_brute_force(spark):
    rng = random.Random(1)
    base = ["information", "general", "Üblichkeit", "straßenbahn", "aaaaaaaa", "abababab", "committee", "THEMSELVES", "überall", "élèves×÷", "x" * 300]
    docs = []
    for k in range(120):
        text = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.15:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("abeé")) + w[at + (kind < 2) :]
            text.append(w)
        docs.append((k, rng.choice([" ", ", ", "\n", " ", "1"]).join(text)))
    docs += [(None, "general general information"), (7, None), (7, ""), (7, "general"), (7, "general")]
    n = words_of(docs)
    assert {r.word: r.n for r in sv.vocabulary(frame(spark, docs)).collect()} == n and len(n) > 100
    got = found(sv.op13_spelling_variants(spark, frame(spark, docs)))
    assert got == grouped(n)
    assert any(r[1] not in (w, r[0]) for w, r in got.items()) or any(r[0] for r in got.values())


def test_pairs_of_any_words(spark):
    """Random words of few letters, in which most edits can be read in several ways; a third share their beginning."""
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(600)}
    words |= {"commonpart" + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(300)}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) + "commonpart" for _ in range(300)}
    n = {w: rng.choice([2, 3, 20, 200, 2000, 20_000]) for w in sorted(words)}
    got = found(sv.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n)
    assert any(r[0] and r[1] != r[0] for r in got.values())  # chains of forms


def test_small_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(7, 9))) for _ in range(900)})
    rows = [(n, back, (w[::-1] if back else w)[: n - n // 2 if back else n // 2], w[::-1] if back else w) for w in words for n in (len(w), len(w) - 1) if n >= 7 for back in (False, True)]
    found = set()
    for n, back in {r[:2] for r in rows}:
        own = sorted(r[2:] for r in rows if r[:2] == (n, back))
        a, b = sv.group_pairs([t for _, t in own], [p for p, _ in own], n, back)
        pairs = [tuple(sorted((own[x][1][::-1], own[y][1][::-1]) if back else (own[x][1], own[y][1]))) for x, y in zip(a, b, strict=True)]
        assert len(set(pairs)) == len(pairs) and not found & set(pairs)
        found |= set(pairs)
    assert found == {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b)}
    monkeypatch.setattr(sv, "CHUNK", 10)
    counts = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    assert {tuple(sorted((r.word, r.near))) for r in sv.near_pairs(counts).collect()} == found


def test_edges(spark):
    assert found(sv.op13_spelling_variants(spark, frame(spark, []))) == {}
    assert found(sv.op13_spelling_variants(spark, frame(spark, [(1, None), (None, ""), (2, "short words only")]))) == {}
    docs = [(k, "abcdefgh " + "zz" * 30_000) for k in range(3)]
    more = frame(spark, docs).withColumns({c: F.lit(1) for c in ("id", "run", "word", "n", "near")})
    assert found(sv.op13_spelling_variants(spark, more)) == grouped(words_of(docs))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no sample tables")
def test_on_the_sample(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    n = words_of([(r.doc_id, r.text) for r in docs.collect()])
    assert found(sv.op13_spelling_variants(spark, docs)) == grouped(n)
