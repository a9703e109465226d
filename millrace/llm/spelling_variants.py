"""Groups of spelling variants: words of a corpus's vocabulary one inserted, deleted or replaced character apart.

Pairs come from a self-join of the vocabulary's trie by active nodes: going down the trie, each node keeps the nodes whose prefix is
at most one edit from its own, and hands them on to its children by the character that both read. A node itself is active at no
edit; its children are active to each other (a replacement) and to itself (an insertion); what is one edit away must read the same
characters from there on. Terminal nodes that are active at the end are pairs. Each depth is a few numpy operations on all active
pairs at once.

The trie is partitioned by prefixes. Two words of n, or n and n + 1, characters that are one edit apart share their first n // 2
characters or their last n - n // 2, so for each n words are dealt by that prefix into one trie of words and one of reversed words: a
group of a task holds words of two lengths that share half of their characters, and pairs that both tries have are taken from
the first. Only distinct words are dealt, so a word that is a third of all text is one row.

Defined results: null texts have no words, null ids spell as nothing in the hash. Of equally frequent near words the first in
code-point order counts. Repeated rows count each. Very long runs are words like others; groups of one word are left out before any
trie is made. No rows, or no word often enough, give no rows. Further columns, whatever their names, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget, map_arrow, stored

#: What isn't part of a run.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Of so many runs, by their hash, one loses a character.
DAMAGED = 31
#: A near word is a word's form if it is so many times as frequent.
TIMES = 10
#: Characters of the words whose trie is held at once; more only if one prefix has more.
CHUNK = 2_000_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that are long and frequent enough, and how often they occur."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, BETWEEN)).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    h, size = F.crc32(F.concat_ws(":", "id", "run")), F.length("run")
    hashed = runs.select("run", h.alias("h"))
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    word = F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def dealt(words: DataFrame) -> DataFrame:
    """(n, back, prefix, text, count): each word in the groups of its own length and of the length below, forward and reversed."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda n: n >= LEAST_LENGTH)
    rows = words.select("word", F.col("n").alias("count"), F.explode(lengths).alias("n"))
    rows = rows.select("word", "count", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    text = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    half = F.floor(F.col("n") / 2).cast("int")
    keep = F.when(F.col("back"), F.col("n") - half).otherwise(half)
    rows = rows.select("n", "back", text.alias("text"), "count", keep.alias("keep"))
    return rows.select("n", "back", F.substring("text", F.lit(1), F.col("keep")).alias("prefix"), "text", "count")


class Trie:
    """A trie of sorted words of n or n + 1 characters, group after group, from the depth of the groups' prefixes on.

    chars: [words, n + 1], 0 where a word has no more. Nodes of a depth are numbered in the order of the words."""

    def __init__(self, chars: np.ndarray, group: np.ndarray, top: int, n: int):
        same = np.concatenate([[False], group[1:] == group[:-1]])
        differ = np.ones((len(chars), n + 2), bool)
        differ[1:, :-1] = chars[1:] != chars[:-1]
        differ[0] = True
        # The first place at which a word leaves the one before it.
        leaves = np.where(same, differ.argmax(axis=1), 0)
        longer = chars[:, n] > 0
        self.chars, self.longer = chars, longer
        self.rows: dict[int, np.ndarray] = {}  # depth -> the first word of each node
        of = {}
        for depth in range(top, n + 2):
            there = longer if depth > n else np.ones(len(chars), bool)
            new = there & ((leaves < depth) | ~same)
            if depth > n:
                new = there  # words differ
            self.rows[depth] = np.flatnonzero(new)
            of[depth] = np.cumsum(new) - 1
        self.char, self.first, self.keys = {}, {}, {}
        for depth in range(top, n + 1):
            below = self.rows[depth + 1]
            parent = of[depth][below]
            self.char[depth] = chars[below, depth].astype(np.int64)
            self.first[depth] = np.searchsorted(parent, np.arange(len(self.rows[depth]) + 1))
            self.keys[depth] = parent * (1 << 21) + self.char[depth]

    def children(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of the nodes, and which of the nodes each is of."""
        first = self.first[depth]
        sizes = first[nodes + 1] - first[nodes]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[nodes] - ends + sizes, sizes), np.repeat(np.arange(len(nodes)), sizes)

    def both_read(self, one_depth: int, one: np.ndarray, two_depth: int, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of pairs of nodes that have the same character."""
        child, pair = self.children(one_depth, one)
        key = two[pair] * (1 << 21) + self.char[one_depth][child]
        keys = self.keys[two_depth]
        if not len(keys):
            return child[:0], child[:0]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        met = keys[at] == key
        return child[met], at[met]

    def siblings(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of one node."""
        parents = self.keys[depth] >> 21
        last = self.first[depth][parents + 1]
        own = np.arange(len(parents))
        sizes = last - own - 1
        ends = np.cumsum(sizes)
        return np.repeat(own, sizes), np.arange(ends[-1] if len(ends) else 0) + np.repeat(own + 1 - ends + sizes, sizes)


def close_pairs(chars: np.ndarray, group: np.ndarray, top: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs of one group that are one edit apart: two words of n characters, or one of n and one of n + 1."""
    trie = Trie(chars, group, top, n)
    none = np.zeros(0, np.int64)
    replaced, inserted = (none, none), (none, none)
    for depth in range(top, n + 1):
        nodes = np.arange(len(trie.rows[depth]))
        child, parent = trie.children(depth, nodes)
        # Active to a node at this depth: what was inserted before, and each of its own children.
        width = len(trie.rows[depth + 1]) + 1
        both = np.unique(np.concatenate([inserted[0] * width + inserted[1], nodes[parent] * width + child]))
        inserted = both // width, both % width
        if depth == n:
            break
        replaced = tuple(np.concatenate(x) for x in zip(trie.siblings(depth), trie.both_read(depth, replaced[0], depth, replaced[1]), strict=True))
        inserted = trie.both_read(depth, inserted[0], depth + 1, inserted[1])
    # A node at depth n ends a word of n characters if its first word has no more.
    ends = ~trie.longer[trie.rows[n]]
    a, b = replaced
    whole = ends[a] & ends[b]
    c, d = inserted
    met = ends[c]
    return np.concatenate([trie.rows[n][a[whole]], trie.rows[n][c[met]]]), np.concatenate([trie.rows[n][b[whole]], trie.rows[n + 1][d[met]]])


def group_pairs(texts: list[str], prefixes: list[str], n: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the close pairs of one length and direction; texts in code-point order within prefixes that follow each other."""
    group = np.cumsum([False, *(a != b for a, b in zip(prefixes[1:], prefixes[:-1], strict=True))])
    kept = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(kept):
        return kept, kept
    chars = np.zeros((len(kept), n + 1), np.uint32)
    sizes = np.array([len(texts[k]) for k in kept])
    flat = np.frombuffer("".join(texts[k] for k in kept).encode("utf-32-le"), np.uint32)
    chars[np.arange(n + 1)[None, :] < sizes[:, None]] = flat
    half = n // 2
    a, b = close_pairs(chars, group[kept], n - half if back else half, n)
    if back:
        # Words of n and n + 1 characters that share their first half as well were met in the trie of words.
        ends = [chars[rows[:, None], sizes[rows][:, None] - 1 - np.arange(half)[None, :]] for rows in (a, b)]
        new = (ends[0] != ends[1]).any(axis=1)
        a, b = a[new], b[new]
    return kept[a], kept[b]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of near words in either direction."""

    def chunks(batches) -> Iterator[tuple]:
        """Runs of whole groups of one n and direction."""
        held: list[list] = [[], [], []]
        now, size = None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "back", "prefix", "text", "count")]
            for n, back, prefix, text, count in zip(*columns, strict=True):
                if now is not None and ((n, back) != now or size > CHUNK and prefix != held[0][-1]):
                    yield *now, *held
                    held, size = [[], [], []], 0
                now = n, back
                for to, x in zip(held, (prefix, text, count), strict=True):
                    to.append(x)
                size += n
        if now is not None:
            yield *now, *held

    def run(batches):
        for n, back, prefixes, texts, counts in chunks(batches):
            a, b = group_pairs(texts, prefixes, n, back)
            words, ns = pa.array(texts, pa.string()), pa.array(counts, pa.int64())
            one, two = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
            for at in range(0, len(one), 50_000):
                x, y = one.slice(at, 50_000), two.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([words.take(x), words.take(y), ns.take(y), pa.array([back] * len(x))], ["word", "near", "near_n", "back"])

    rows = dealt(words).repartition("n", "back", "prefix").sortWithinPartitions("n", "back", "prefix", "text")
    pairs = map_arrow(rows, run, "word string, near string, near_n bigint, back boolean")
    straight = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    return pairs.select(straight("word"), straight("near"), "near_n")


def roots(forms: DataFrame) -> tuple[DataFrame, str]:
    """(word, root): the last word that forms (word, form) lead to; stored. Counts grow along a chain, so chains end, and
    each round doubles what is behind."""
    spark = forms.sparkSession
    now, path = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = now.select(F.col("word").alias("from"), F.col("root").alias("to"))
        after, written = stored(now.join(onward, now["root"] == onward["from"], "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "variant-roots")
        forget(spark, path)
        moved, now, path = not after.filter("moved").isEmpty(), after.drop("moved"), written
        if not moved:
            return now, path


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    spark = words.sparkSession
    pairs, at_pairs = stored(near_pairs(words), "variant-pairs")
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("most")
    near, at_near = stored(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most).select(F.col("word").alias("of"), "n_near", F.col("most.near").alias("near"), (-F.col("most.less")).alias("near_n")), "variant-near")
    rows = words.join(near, words["word"] == near["of"], "left")
    formed = F.col("near_n") >= TIMES * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    rows, _ = stored(rows, "variants")
    last, _ = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    last = last.withColumnRenamed("word", "of")
    forget(spark, at_pairs, at_near)
    return rows.join(last, rows["word"] == last["of"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    words, _ = stored(vocabulary(docs), "vocabulary")
    return variants(words)
