"""Word segmentation: a native expression, and a Python table function with the same contract."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CJK = r"぀-ヿ㐀-䶿一-鿿가-힯"


def tokens(text: Column) -> Column:
    """Distinct tokens: runs of letters and digits in lower case; characters of East Asian scripts stand alone."""
    spaced = F.regexp_replace(F.lower(text), f"([{CJK}])", " $1 ")
    return F.array_distinct(F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def segment(text: str | None) -> Iterable[str]:
    """The same in Python."""
    spaced = re.sub(f"([{CJK}])", r" \1 ", (text or "").lower())
    return dict.fromkeys(t for t in re.split(r"[^\w]+|_", spaced) if t)


def register_tokenizer(spark: SparkSession, name: str = "tokenize", tokenizer: Callable[[str | None], Iterable[str]] = segment) -> None:
    """A table function name(text) -> (w), for LATERAL joins, with any tokenizer."""

    class Tokenize:
        def eval(self, text: str):
            for word in tokenizer(text):
                yield (word,)

    spark.udtf.register(name, F.udtf(Tokenize, returnType="w string"))
