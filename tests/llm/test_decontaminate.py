import hashlib
import random
import re

from millrace.llm import decontaminate


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, names = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            if not own:
                continue
            width = min(13, len(own))
            grams = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
            for i in range(len(words) - width + 1):
                if tuple(words[i : i + width]) in grams:
                    hit |= set(range(i, i + width))
                    names.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def case(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C", "dé", "E9", "日本", "f", "g"] + [f"v{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 12, 13, 14, 30, 60]))) for i in range(30)] + [(50, None), (51, "..."), (7, text(20))]
    docs = [(1000, None), (1001, ""), (1002, "!?"), (1003, text(20000))]
    for d in range(150):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(own))
            parts += [" ".join(own[a : a + rng.randint(5, 40)]).upper(), text(rng.randint(0, 80))]
        docs.append((d, " ".join(parts)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = case(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items))
    for size in (8 << 20, 400):
        rows = decontaminate.marked(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=size)
        assert sorted(tuple(r) for r in decontaminate.digested(rows).collect()) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, __n_hit string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean_documents(docs, none).count() == 3
    assert decontaminate.clean_documents(docs, spark.createDataFrame([(None, "A, B")], "item_id long, text string")).count() == 1
    assert decontaminate.clean_documents(docs.limit(0), none).count() == 0


def test_words_that_differ_have_other_hashes():
    """Also where a polynomial modulo a power of two has none: a Thue-Morse word and its complement."""
    word = b"a"
    while len(word) < 4096:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    hashes, counts = decontaminate.word_hashes([word, other, b"ab ba", b"", word + b" " + other])
    assert counts.tolist() == [1, 1, 2, 0, 2] and len(set(hashes.tolist())) == 4
    assert hashes[4:].tolist() == hashes[:2].tolist()


def test_very_long_texts_in_pieces():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdef") for _ in range(rng.randint(1, 9))) for _ in range(900_000)]
    long = b" ".join(words)
    hashes, counts = decontaminate.word_hashes([b"x y", long, b"z"])
    assert counts.tolist() == [2, len(words), 1]
    some = [0, 1, 399_999, 400_000, 899_999]
    assert [hashes[2 + k] for k in some] == [decontaminate.word_hashes([words[k]])[0][0] for k in some]
