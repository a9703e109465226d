"""Word segmentation by a dictionary: text that is written without spaces becomes the words of its likeliest reading.

The dictionary is a table (word, n). Its words are an automaton that finds all of them in a text in one pass; they are the edges of
a graph over the text's places, and the best path by the words' frequencies is the reading (a unigram model). A character that
no word covers is a word of its own, less likely than any other. Runs of other scripts don't come here: the native expression
of text.py cuts them, and its tokens and these have one contract (distinct, in lower case, in order).

The dictionary goes whole to every worker, so its size is checked: at most MOST_WORDS words."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CJK

MOST_WORDS = 1_000_000


class Segmenter:
    """Best paths over the words of a dictionary."""

    def __init__(self, words: dict[str, int]):
        self.words = {w: n for w, n in words.items() if w and n > 0}
        self.total = sum(self.words.values()) or 1
        self.automaton = None

    def __getstate__(self):
        return {"words": self.words, "total": self.total, "automaton": None}

    def _edges(self, text: str) -> list[list[tuple[int, float]]]:
        """For each place the words that end there: where they begin, and their log frequency."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, n in self.words.items():
                self.automaton.add_word(word, (len(word), math.log(n / self.total)))
            self.automaton.make_automaton()
        edges: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        if self.words:
            for last, (size, weight) in self.automaton.iter(text):
                edges[last + 1].append((last + 1 - size, weight))
        return edges

    def segment(self, text: str) -> list[str]:
        """The words of the likeliest reading, all of the text; of equally likely ones the one whose last words are longer."""
        unknown = math.log(1 / self.total) - 10
        best, begin = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
        for end, found in enumerate(self._edges(text)[1:], 1):
            for start, weight in sorted(found) or [(end - 1, unknown)]:
                if best[start] + weight > best[end]:
                    best[end], begin[end] = best[start] + weight, start
            if best[end - 1] + unknown > best[end]:
                best[end], begin[end] = best[end - 1] + unknown, end - 1
        out, at = [], len(text)
        while at:
            out.append(text[begin[at] : at])
            at = begin[at]
        return out[::-1]


def segmenter_of(dictionary: DataFrame) -> Segmenter:
    """The dictionary (word, n) for segmenting: an error if it has more than MOST_WORDS words."""
    rows = dictionary.groupBy("word").agg(F.sum("n").alias("n")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    return Segmenter({r.word: r.n for r in rows if r.word})


def segments(segmenter: Segmenter):
    """A vectorised function: text -> array of words."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: segmenter.segment(t) if t else [])

    return cut


def dictionary_tokens(text: Column, segmenter: Segmenter) -> Column:
    """Distinct tokens as text.tokens() has them, but runs of East Asian scripts in words of the dictionary. Texts without such
    a run have none to hand over."""
    spaced = F.regexp_replace(F.lower(text), f"([{CJK}]+)", " $1 ")
    pieces = F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    runs = F.array_join(F.filter(pieces, lambda t: t.rlike(f"^[{CJK}]")), " ")
    cut = F.filter(segments(segmenter)(F.when(runs != "", runs)), lambda w: w != " ")
    rest = F.filter(pieces, lambda t: ~t.rlike(f"^[{CJK}]"))
    return F.array_distinct(F.concat(rest, F.coalesce(cut, F.array().cast("array<string>"))))


def table_function(segmenter: Segmenter):
    """For register_tokenizer(): words of a text, whatever its script."""

    def words(text: str | None) -> Iterable[str]:
        return dict.fromkeys(w for w in segmenter.segment((text or "").lower()) if not w.isspace())

    return words
