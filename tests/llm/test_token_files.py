import random
import zlib

import numpy as np
import pytest

from millrace.llm import huffman, token_files
from millrace.llm.common import scratch_path


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 1), (3, 2), (300, 9), (300, 16), (40000, 16)])
def test_huffman_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 7, np.int64)
    counts[rng.permutation(n + 7)[:n]] = (2 ** (rng.random(n) * 30)).astype(np.int64) + 1
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths > 0).sum() == n
    assert n < 2 or sum(2.0 ** -int(x) for x in lengths if x) == 1
    book = huffman.Codebook(lengths)
    used = np.flatnonzero(lengths)
    blocks = [used[rng.integers(0, n, size)] for size in (0, 1, 255, 256, 257, 5000)]
    coded = [(*book.encode(b), len(b)) for b in blocks]
    assert all((a == b).all() for a, b in zip(book.decode(coded), blocks, strict=True))


def test_lengths_are_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1, 1, 2])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 16) * counts).sum()) == cost


def rows_of(seed):
    rng = random.Random(seed)
    parts = ["The", " ", "  ", "\n", "don't", "<|endoftext|>", "<|x|>", "É", "é", "　", "\x1c", "日本", "123", "ΣΑΣ", "!?", "ing", "Über.", "ſŉ", "İx", "J\u030c", "straße,", "it's", "Word;"]
    rows = [(7, None), (3, ""), (5, " "), (5, "twice"), (-2, "x" * 3000), (10**12, "far " * 70000)]
    return rows + [(rng.randrange(10**6), "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for _ in range(300)]


def test_files_hold_what_the_library_gives(spark):
    from tokenizers import Tokenizer

    rows = rows_of(2)
    tok = Tokenizer.from_file(token_files.vocabulary())
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = scratch_path(spark, "test")
    token_files.write_token_files(docs, token_files.vocabulary(), out, parts=3)
    got = {}
    for r in token_files.read_token_files(spark, out).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(token_files.token_digests(spark, out).collect(), key=lambda r: r.start):
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want[r.doc_id]]
        at += r.n_tokens
    assert [r.doc_id for r in sorted(token_files.token_digests(spark, out).collect(), key=lambda r: r.start)] == sorted(i for i, _ in rows)


def test_words_as_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    letters = [chr(c) for c in [*range(33, 0x250), 0x301, 0x30C, 0x212A, 0x2019]]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(20000)]
    words += ["".join(rng.choice("abcxyzéüßñ") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", "!", ".."]) for _ in range(20000)]
    words = [w for w in words if w.split() == [w] and w.encode().split() == [w.encode()]]
    tok = Tokenizer.from_file(token_files.vocabulary())
    ids, n = token_files.load(token_files.vocabulary())[0].encode_words([w.encode() for w in words])
    got = np.split(ids, np.cumsum(n)[:-1])
    for w, g, e in zip(words, got, tok.encode_batch(words, add_special_tokens=False), strict=True):
        assert g.tolist() == e.ids, w


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, part int")
    assert token_files.op2_token_files(spark, empty).count() == 0
    odd = spark.createDataFrame([(None, "a", "x", 1), (1, None, "y", 2)], "doc_id long, text string, ids string, part int")
    assert sorted((r.start, r.doc_id) for r in token_files.op2_token_files(spark, odd).collect()) == [(0, None), (2, 1)]


def test_rows_of_one_id_have_one_order(spark):
    rows = [(k % 3 or None, f"text {k} " + "word " * (k % 7)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(repr, token_files.op2_token_files(spark, d).collect())) for d in (docs.repartition(5), docs.repartition(3, "text"), docs.orderBy("text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60
