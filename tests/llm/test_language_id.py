import random
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import language_id as li

SYLLABLES = {"xa": "ka lo mi tu ne".split(), "yb": "str öng ält pf sch".split(), "zc": "ción es la ñu ar".split()}


def text_in(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def naive_log_p(texts, probes, alphabet):
    """Interpolated Kneser-Ney by the definition, over dictionaries."""
    counts = {n: defaultdict(Counter) for n in range(1, li.ORDER + 1)}
    full = Counter()
    for t in texts:
        for i in range(li.ORDER - 1, len(t)):
            full[t[i - li.ORDER + 1 : i + 1]] += 1
    level = dict(full)
    for n in range(li.ORDER, 0, -1):
        for g, c in level.items():
            counts[n][g[:-1]][g[-1]] = c
        level = Counter(g[1:] for g in level)
    discount = {}
    for n in counts:
        every = [c for own in counts[n].values() for c in own.values()]
        once, twice = every.count(1), every.count(2)
        discount[n] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def p(n, context, c):
        if n == 0:
            return 1 / alphabet
        own = counts[n].get(context)
        if own is None:
            return p(n - 1, context[1:], c)
        mass, d = sum(own.values()), discount[n]
        return max(own[c] - d, 0) / mass + d * len(own) / mass * p(n - 1, context[1:], c)

    return [np.log(p(li.ORDER, g[:-1], g[-1])) for g in probes]


def test_log_probabilities_by_definition():
    rng = random.Random(1)
    models, own = {}, {}
    for lang in SYLLABLES:
        texts = [text_in(lang, rng, 30) for _ in range(20)]
        code, _, _ = li.symbols(texts)
        place = np.flatnonzero(code != li.PAD)
        grams = np.array([code[i - li.ORDER + 1 : i + 1] for i in place])
        rows, n = np.unique(grams, axis=0, return_counts=True)
        models[lang] = li.fit_language(rows, n, 40)
        own[lang] = ["\x01" * (li.ORDER - 1) + t for t in texts]
    scorer = li.Scorer(models)
    probe = [text_in(lang, rng, 8) + " qqq wxyz" for lang in SYLLABLES]
    entropy, letters = scorer.cross_entropy(probe)
    for i, t in enumerate(probe):
        padded = "\x01" * (li.ORDER - 1) + t
        probes = [padded[k : k + li.ORDER] for k in range(len(t))]
        for k, lang in enumerate(scorer.langs):
            assert abs(entropy[i, k] + np.mean(naive_log_p(own[lang], probes, 40))) < 1e-4
        assert letters[i] == sum(map(str.isalpha, t))


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(2)
    rows = [(i, text_in(lang := rng.choice(sorted(SYLLABLES)), rng, rng.randint(5, 60)), lang if rng.random() < 0.9 else None) for i in range(1200)]
    truth = {r[0]: r[2] for r in rows}
    odd = [(9000, None, "xa"), (9001, "", "xa"), (9002, "12 !?", "yb"), (9003, "Ω≈ç √∫ ЖЩЮ " * 30, None), (None, "kalo", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in li.op1_language_id(spark, docs).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got.values() if r.held_out and truth.get(r.doc_id)]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[k].lang_pred for k in (9000, 9001, 9002)} == {"und"} and got[9003].rejected
    assert sum(r.rejected for r in got.values() if r.doc_id in truth) < 10


def test_edges(spark):
    schema = "doc_id long, text string, lang string, __lang int, score string"
    assert li.op1_language_id(spark, spark.createDataFrame([], schema)).count() == 0
    none = spark.createDataFrame([(1, "abc", None, 1, "x"), (1, "abc", None, 1, "x")], schema)
    assert [r.lang_pred for r in li.op1_language_id(spark, none).collect()] == ["und", "und"]
    assert li.accepted_documents(none).columns == none.columns


def test_no_gram_is_left_out(spark):
    rng = random.Random(5)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(1000)) for _ in range(160)] + ["的了" * 50]
    rows = spark.createDataFrame([("zh", t) for t in texts], "lang string, text string").repartition(4)
    grams = li.all_grams(li.gram_counts(rows))["zh"]
    want = Counter(p[i : i + li.ORDER] for t in texts for p in ["\x01" * (li.ORDER - 1) + t] for i in range(len(t)))
    got = {"".join(map(chr, g)): n for g, n in zip(grams[0].tolist(), grams[1].tolist(), strict=True)}
    assert got == want and len(want) > 150_000
    model = li.train(rows, rows.limit(1))
    assert len(model.models["zh"].hashes[li.ORDER]) == len(want)


def test_sparse_classes_have_limits(spark):
    rng = random.Random(7)
    frame = lambda rows: spark.createDataFrame(rows, "lang string, text string")
    labelled = frame([(lang, text_in(lang, rng, 30)) for lang in SYLLABLES for _ in range(150)])
    short = [("xa", text_in("xa", rng, 2)) for _ in range(3)]
    model = li.train(labelled, frame([(lang, text_in(lang, rng, 30)) for lang in SYLLABLES for _ in range(40)] + short))
    assert np.isfinite(model.limits).all()
    assert not any(model.predict([t for _, t in short])[4]) and model.predict(["ЖЩЮ Ω", "ЖЩЮ Ω" * 2000])[4].all()
    assert np.isinf(li.train(labelled, frame([])).limits).all()


def test_limits_read_all_calibration_texts(spark):
    rng = random.Random(8)
    labelled = spark.createDataFrame([("xa", text_in("xa", rng, 30)) for _ in range(100)], "lang string, text string")
    usual = spark.createDataFrame([("xa", text_in("xa", rng, 30)) for _ in range(50)], "lang string, text string")
    many = usual.crossJoin(spark.range(600).select()).unionByName(spark.createDataFrame([("xa", "ЖЩЮ" * 30)] * 40, "lang string, text string"))
    least = min(li.train(labelled, many).predict(["ЖЩЮ" * 30])[2])
    model = li.train(labelled, many)
    assert model.limits[0, 2] == 1.25 * least  # 40 of 30,040 are more than 0.05 %


def test_windows_of_one_very_long_text_are_the_whole():
    rng = np.random.default_rng(5)
    words = ["der", "die", "und", "haus", "the", "and", "house", "of"]
    long = " ".join(words[k] for k in rng.integers(0, 8, 600_000))
    model = li.LanguageIdentifier({lang: li.fit_language(*grams_of(text), 40) for lang, text in {"de": "der die und haus", "en": "the and house of"}.items()})
    entropy, letters = model.scorer.cross_entropy([long, "the house"])
    code, text_of, _ = li.symbols([long])
    place = np.flatnonzero(code != li.PAD)
    whole = -model.scorer._log_p(li.ORDER, li.gram_hashes(code), place).sum(axis=0, dtype=np.float64) / len(place)
    assert len(code) > 2_000_000 and np.allclose(entropy[0], whole, rtol=1e-5)


def grams_of(text):
    code, _, _ = li.symbols([text])
    place = np.flatnonzero(code != li.PAD)
    rows, n = np.unique(code[place[:, None] + np.arange(1 - li.ORDER, 1)], axis=0, return_counts=True)
    return rows, n


def test_labelled_rows_are_a_bounded_sample(spark):
    rows = [("en", f"some words of text number {k}") for k in range(2000)] + [("de", f"ein paar Worte {k}") for k in range(20)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    assert li.bounded_sample(labelled).count() == 2020
    kept = li.bounded_sample(labelled, 10_000).collect()
    chars = sum(len(r.text) for r in kept if r.lang == "en")
    assert 7000 < chars < 13_000 and sum(r.lang == "de" for r in kept) == 20
    again = li.bounded_sample(labelled.repartition(7), 10_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept))
    assert li.bounded_sample(labelled.filter("false"), 10).count() == 0
