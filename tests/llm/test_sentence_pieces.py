import hashlib
import random

from millrace.llm import sentence_pieces


def texts_of(seed):
    rng = random.Random(seed)
    parts = [" ", " ", "▁", "\n", "a", "b", "the", "ing", "é", "日", "👍", "0", "<s>", "\t", "  ", "    ", "ll", "　", "́"]
    texts = [None, "", " ", "   a", "a \nb", "\n\n x", "x\n", "▁▁a▁", "<0x0A>", "\x00", " " * 500, "a" * 3000, "ab" * 700]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    return texts + ["".join(rng.choice(parts) for _ in range(900)).replace(" ", "x") for _ in range(10)]


def test_as_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.vocabulary())
    texts = texts_of(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentence_pieces.encode(docs, sentence_pieces.vocabulary()).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids == ids and r.decoded.decode() == lib.decode(ids)
    for r in sentence_pieces.op7_sentencepiece(spark, docs).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_edges(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    assert sentence_pieces.op7_sentencepiece(spark, spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(None, "a", "x", 1), (1, None, "y", 2), (1, None, "y", 2)], schema)
    assert sorted(r.n_tokens for r in sentence_pieces.op7_sentencepiece(spark, twice).collect()) == [1, 1, 2]


def test_long_words_as_the_library():
    """Lines without spaces, in few rounds whatever their length."""
    import base64

    import sentencepiece

    path, rng = sentence_pieces.vocabulary(), random.Random(2)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    words = "the of and ing station entire lead other information general there here with".split()
    texts = ["".join(rng.choice(words) for _ in range(20_000)), base64.b64encode(rng.randbytes(40_000)).decode(), "".join(rng.choice("acgt") for _ in range(40_000))]
    texts += ["".join(rng.choice("のにはを日本語人大") for _ in range(40_000)), "the" * 20_000, "".join(rng.choice("0123456789") for _ in range(50_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(30_000))]
    texts += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    ids, counts = sentence_pieces.encode_texts(path, [t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == lib.encode(text, add_eos=True)
        at += n


def same_as_library(texts):
    import sentencepiece

    path = sentence_pieces.vocabulary()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, counts = sentence_pieces.encode_texts(path, [t.encode() for t in texts])
    ends = counts.cumsum().tolist()
    for text, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == lib.encode(text, add_eos=True), repr(text)[:200]


def test_runs_of_one_character_as_the_library():
    """Pieces that are runs of one character share a rank where they are blanks."""
    same_as_library([c * n for c in " \ta-=_.*#0é日▁" for n in range(1, 1001)])
    same_as_library([" " * 100_003, "x" + " " * 50_000 + "y"])
    same_as_library([f"{a}{' ' * n}{b}" for a, b in [("x", "y"), ("a\n", "b"), ("x ", "\n"), ("", "if"), ("日", "-")] for n in range(1, 1001)])


def test_mixed_texts_as_the_library():
    rng = random.Random(5)
    model, _ = sentence_pieces.load(sentence_pieces.vocabulary())
    spelled = [p.replace("▁", " ") for p in model.pieces[300:]]
    texts = ["".join(rng.choice(spelled) for _ in range(rng.randint(1, 25))) for _ in range(10_000)]
    texts += ["".join(rng.choice([" " * rng.randint(1, 70), "\n", "\t" * rng.randint(1, 9), "-" * rng.randint(1, 40), rng.choice(spelled)]) for _ in range(rng.randint(1, 25))) for _ in range(10_000)]
    same_as_library(texts)
