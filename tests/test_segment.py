"""Segmentation against all readings of short texts."""

import math
import random

import pytest

from millrace.functions import segment, text


def readings(t, words, unknown):
    """Every way to read a text, with its weight."""
    if not t:
        yield [], 0.0
    for k in range(1, len(t) + 1):
        weight = words.get(t[:k], unknown if k == 1 else None)
        if weight is not None:
            for rest, w in readings(t[k:], words, unknown):
                yield [t[:k], *rest], weight + w


def test_best_path_against_all_readings():
    rng = random.Random(1)
    for _ in range(300):
        counts = {"".join(rng.choice("中国人民") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(8)}
        total = sum(counts.values())
        cut = segment.Segmenter(counts)
        t = "".join(rng.choice("中国人民大") for _ in range(rng.randint(0, 9)))
        got = cut.segment(t)
        assert "".join(got) == t
        words = {w: math.log(n / total) for w, n in counts.items()}
        unknown = math.log(1 / total) - 10
        weight = sum(words.get(w, unknown) for w in got)
        assert weight == pytest.approx(max(w for _, w in readings(t, words, unknown)))


def test_tokens_mix_scripts(spark):
    words = spark.createDataFrame([("中国", 10), ("人民", 10), ("国人", 1), ("中国", 5), (None, 3), ("", 3)], "word string, n long")
    cut = segment.segmenter_of(words)
    docs = spark.createDataFrame([(1, "Red 中国人民 ring, red"), (2, None), (3, ""), (4, "no CJK here"), (5, "中国、人民x中国"), (6, "大" * 3)], "id int, t string")
    got = {r.id: r.w for r in docs.select("id", segment.dictionary_tokens(docs["t"], cut).alias("w")).collect()}
    assert got == {1: ["red", "ring", "中国", "人民"], 2: None, 3: [], 4: ["no", "cjk", "here"], 5: ["x", "中国", "人民"], 6: ["大"]}
    assert segment.Segmenter({}).segment("ab") == ["a", "b"]


def test_dictionary_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(segment, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        segment.segmenter_of(spark.range(5).selectExpr("string(id) AS word", "1L AS n"))


def test_as_a_table_function(spark):
    cut = segment.Segmenter({"黄金": 5, "项链": 5})
    text.register_tokenizer(spark, "cut_words", segment.table_function(cut))
    assert [r.w for r in spark.sql("SELECT w FROM (SELECT '黄金项链' AS t), LATERAL cut_words(t)").collect()] == ["黄金", "项链"]
