"""Language identification by interpolated Kneser-Ney character language models.

Training counts 5-grams of characters per language over the labelled training texts, in the executors. The driver gets all
of them, a language at a time, derives discounts and the lower orders (continuation counts) from them, and keeps each
language's grams in arrays sorted by hash. For scoring, the arrays are merged order by order: one look-up of a character's
longest gram gives its log-probability under every language, and grams that no language has go to the next lower order with
the back-off weight of their context. A text gets the language of the lowest cross-entropy a character. Rejection is
calibrated on all training texts that the counts don't hold: per language and length class, a text is rejected whose
cross-entropy lies beyond what nearly all calibration texts of that class have. Classes with few texts also take the limit
that all languages' texts of that length give, so every class has one wherever there is any calibration text.

The counts are of all labelled rows up to LABELLED_CHARS characters a language, a sample of whole rows beyond: that bounds what
the driver and each worker hold, whatever the corpus. All grams counted stay in the model, and all calibration texts set the limits.

Defined results: a text that is null or without a letter is `und`, score 0, rejected. Without any labelled text all are
`und`. Ties go to the language that sorts first. Repeated rows are predicted alike; no rows give no rows. Columns added are
named by a prefix that no column of the documents begins with, so these may have any name. A very long text is scored and
counted a window of symbols at a time; its symbols, some 30 bytes a character, are in a task at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, free_prefix, map_arrow, slices, stored

ORDER = 5
PAD, GAP = 1, 32
MULTIPLIER = 0x9E3779B97F4A7C15
#: Its powers modulo 2 to the 64th, one for each place in a gram.
POWERS = [np.uint64(pow(MULTIPLIER, k, 1 << 64)) for k in range(8)]
#: Characters of labelled rows that a language's model is fitted on at most; rows beyond are left out by a hash of their text.
LABELLED_CHARS = 400_000_000
#: A text's evidence for the score counts this many characters at most.
SCORE_CHARS = 50
#: Lower ends of the length classes, in characters.
LENGTHS = np.array([1, 16, 64, 256, 1024, 4096])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row: letters in lower case, one GAP for each run of others, ORDER-1 PADs before each
    text; the text each belongs to; how many letters each text has."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(("\x01" * (ORDER - 1)) + t for t in low).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) + ORDER - 1 for t in low], np.int64)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    pad = np.zeros(len(code), bool)
    for k in range(ORDER - 1):
        pad[begins + k] = True
    letter = _letters()[code]
    out = np.where(letter, code, np.uint32(GAP))
    out[pad] = PAD
    keep = letter | pad
    keep[1:] |= letter[:-1]  # a gap right after a letter stays
    return out[keep], text_of[keep], np.bincount(text_of[letter], minlength=len(texts))


def gram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """hashes[n - 1][i]: of the n symbols that end at i, for i >= n - 1 (earlier places hold no gram)."""
    code = code.astype(np.uint64)
    out = [code.copy()]
    for n in range(2, ORDER + 1):
        h = out[-1].copy()
        h[n - 1 :] += code[: len(code) - n + 1] * POWERS[n - 1]
        out.append(h)
    return out


def windows(code: np.ndarray, limit: int = 1_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """Windows of the symbols, each with ORDER-1 symbols of the one before as context: where what is new begins, and the
    window. What is computed for one very long text is so held for a window at a time."""
    shared = ORDER - 1
    yield 0, code[: limit + shared]
    for at in range(limit, len(code) - shared, limit):
        yield shared, code[at : at + limit + shared]


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class SortedHashes:
    """Sorted 64-bit hashes with an index of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        bits = max(4, int(np.ceil(np.log2(max(2, self.n)))) + 2)
        self.shift = np.uint64(64 - bits)
        lead = (keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange(1 << bits)).astype(np.int32)
        self.most = int(np.bincount(lead).max()) if self.n else 0
        self.keys = np.concatenate([keys, np.full(self.most + 1, ~np.uint64(0))])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and the positions in h of those that aren't there."""
        at = self.start[(h >> self.shift).astype(np.int64)].astype(np.int64)
        rest = np.flatnonzero(self.keys[at] != h)
        for step in range(1, self.most):
            if not len(rest):
                break
            same = self.keys[at[rest] + step] == h[rest]
            at[rest[same]] += step
            rest = rest[~same]
        return at, rest


@dataclass
class CharModel:
    """One language: per order n, hashes (sorted) of n-grams with their log-probabilities, and of contexts with the log of
    their back-off weights. grams[n] has the symbols."""

    grams: dict[int, np.ndarray] = field(default_factory=dict)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    log_p: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    log_back_off: dict[int, np.ndarray] = field(default_factory=dict)
    log_unseen: float = 0.0


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h += rows[:, k].astype(np.uint64) * POWERS[rows.shape[1] - 1 - k]
    return spread(h)


def fit_language(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> CharModel:
    """Interpolated Kneser-Ney from the counts of ORDER-grams; lower orders count distinct continuations."""
    model, levels = CharModel(), {}
    for n in range(ORDER, 0, -1):
        h = _row_hash(grams)
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=counts if n == ORDER else None, minlength=len(h)).astype(np.float64)
        grams = grams[first]
        levels[n] = (h, grams, total)
        grams, counts = grams[:, 1:], None
    lower = None
    for n in range(1, ORDER + 1):
        h, rows, total = levels[n]
        once, twice = (total == 1).sum(), (total == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        context = _row_hash(rows[:, :-1]) if n > 1 else np.zeros(len(rows), np.uint64)
        contexts, inverse = np.unique(context, return_inverse=True)
        mass, kinds = np.bincount(inverse, weights=total), np.bincount(inverse)
        back_off = discount * kinds / mass
        if n == 1:
            below = np.full(len(rows), 1 / alphabet)
            model.log_unseen = float(np.log(back_off[0] / alphabet))
        else:
            below = np.exp(lower[1][np.searchsorted(lower[0], _row_hash(rows[:, 1:]))])
        p = (total - discount) / mass[inverse] + back_off[inverse] * below
        model.grams[n], model.hashes[n], model.log_p[n] = rows, h, np.log(p)
        model.contexts[n], model.log_back_off[n] = contexts, np.log(back_off)
        lower = (h, model.log_p[n])
    return model


class Scorer:
    """All languages' arrays merged: per order one sorted array of hashes, with a column of log-probabilities a language."""

    def __init__(self, models: dict[str, CharModel]):
        self.langs = sorted(models)
        own = [models[k] for k in self.langs]
        self.unseen = np.array([m.log_unseen for m in own], np.float32)
        self.index, self.log_p, self.contexts, self.back_off = {}, {}, {}, {}
        for n in range(1, ORDER + 1):
            h = np.unique(np.concatenate([m.hashes[n] for m in own]))
            rows = np.zeros((len(h), n), np.uint32)
            table = np.full((len(h), len(own)), np.nan, np.float32)
            for k, m in enumerate(own):
                at = np.searchsorted(h, m.hashes[n])
                rows[at], table[at, k] = m.grams[n], m.log_p[n]
            if n > 1:
                contexts = np.unique(np.concatenate([m.contexts[n] for m in own]))
                weights = np.zeros((len(contexts), len(own)), np.float32)
                for k, m in enumerate(own):
                    weights[np.searchsorted(contexts, m.contexts[n]), k] = m.log_back_off[n]
                self.contexts[n], self.back_off[n] = SortedHashes(contexts), weights
                backed = weights[np.searchsorted(contexts, _row_hash(rows[:, :-1]))] + self.log_p[n - 1][np.searchsorted(self._keys(n - 1), _row_hash(rows[:, 1:]))]
                table = np.where(np.isnan(table), backed, table)
            else:
                table = np.where(np.isnan(table), self.unseen, table)
            self.index[n], self.log_p[n] = SortedHashes(h), table.astype(np.float32)

    def _keys(self, n: int) -> np.ndarray:
        return self.index[n].keys[: self.index[n].n]

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol under each language, and the number of letters; rows without letters are NaN."""
        code, text_of, letters = symbols(texts)
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for start, part in windows(code):
            place = start + np.flatnonzero(part[start:] != PAD)
            value, own = self._log_p(ORDER, gram_hashes(part), place), text_of[: len(part)][place]
            sums += np.stack([np.bincount(own, weights=value[:, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
            n += np.bincount(own, minlength=len(texts))
            text_of = text_of[len(part) - (ORDER - 1) :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(letters[:, None] > 0, -sums / n[:, None], np.nan), letters

    def _log_p(self, n: int, hashes: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        at, missing = self.index[n].find(spread(hashes[n - 1][place]))
        at[missing] = 0
        out = self.log_p[n][at]
        if len(missing):
            where = place[missing]
            if n == 1:
                out[missing] = self.unseen
            else:
                low = self._log_p(n - 1, hashes, where)
                found, unknown = self.contexts[n].find(spread(hashes[n - 2][where - 1]))
                found[unknown] = 0
                weight = self.back_off[n][found]
                weight[unknown] = 0
                out[missing] = low + weight
        return out


class LanguageIdentifier:
    def __init__(self, models: dict[str, CharModel]):
        self.models = models
        self.limits = np.full((len(models), len(LENGTHS)), np.inf)
        self._scorer: Scorer | None = None

    def __getstate__(self):
        return self.__dict__ | {"_scorer": None}

    @property
    def scorer(self) -> Scorer:
        if self._scorer is None:
            self._scorer = Scorer(self.models)
        return self._scorer

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies of the language chosen, letters, whether each text is rejected."""
        if not self.models:
            n = len(texts)
            return ["und"] * n, np.zeros(n), np.full(n, np.nan), symbols([t or "" for t in texts])[2], np.ones(n, bool)
        entropy, letters = self.scorer.cross_entropy([t or "" for t in texts])
        some = letters > 0
        filled = np.where(some[:, None], entropy, 0)
        best = filled.argmin(axis=1)
        least = filled[np.arange(len(best)), best]
        gap = (filled - least[:, None]) * np.minimum(letters, SCORE_CHARS)[:, None]
        score = np.where(some, 1 / np.exp(-gap).sum(axis=1), 0.0)
        size = np.maximum(np.searchsorted(LENGTHS, letters, "right") - 1, 0)
        rejected = ~some | (least > self.limits[best, size])
        return [self.scorer.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], score, np.where(some, least, np.nan), letters, rejected


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text); tasks sum what they read before it is shuffled."""

    def emit(held):
        for lang, parts in held.items():
            h = np.concatenate([p[0] for p in parts])
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            held[lang] = [(h, n, np.concatenate([p[2] for p in parts])[first])]

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    code, _, _ = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    for start, part_code in windows(code):
                        h = gram_hashes(part_code)[-1]
                        place = start + np.flatnonzero(part_code[start:] != PAD)
                        h, first, n = np.unique(h[place], return_index=True, return_counts=True)
                        rows = part_code[place[first][:, None] + np.arange(1 - ORDER, 1)]
                        held.setdefault(lang, []).append((h, n, rows))
                        size += len(h)
                if size > 600_000:
                    emit(held)
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > 400_000:
                        yield from _gram_rows(held)
                        held, size = {}, 0
        emit(held)
        yield from _gram_rows(held)

    counted = map_arrow(rows.select("lang", "text"), run, "lang string, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _gram_rows(held):
    for lang, parts in held.items():
        for _, n, rows in parts:
            text = np.ascontiguousarray(rows, np.uint32).tobytes().decode("utf-32-le")
            grams = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def all_grams(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Every gram counted, with its count, by language; one language at a time is on its way to the driver."""
    out = {}
    for lang in sorted(r.lang for r in counts.select("lang").distinct().collect()):
        own = counts.filter(F.col("lang") == F.lit(lang)).select("gram", "n").toArrow()
        code = [np.frombuffer("".join(c.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER) for c in own.column("gram").chunks]
        out[lang] = (np.concatenate(code), own.column("n").to_numpy())
    return out


def train(labelled: DataFrame, calibration: DataFrame, rejected_share: float = 0.0005, margin: float = 1.25) -> LanguageIdentifier:
    """labelled, calibration: (lang, text), lang not null, kept apart."""
    counts, path = stored(gram_counts(labelled), "gram-counts")
    kept = all_grams(counts)
    forget(labelled.sparkSession, path)
    alphabet = len(np.unique(np.concatenate([np.zeros(1, np.uint32), *(g[:, -1] for g, _ in kept.values())]))) + 1
    model = LanguageIdentifier({lang: fit_language(g, n, alphabet) for lang, (g, n) in kept.items()})
    if model.models:
        model.limits = rejection_limits(calibration, model, rejected_share) * margin
    return model


def rejection_limits(calibration: DataFrame, model: LanguageIdentifier, rejected_share: float) -> np.ndarray:
    """Per language and length class, the cross-entropy that the share rejected_share of the calibration texts exceeds.

    A class of fewer than 1 / rejected_share texts, whose quantile is no more than the largest value met, takes the larger of
    that and what the length class gives over all languages: the quantile of cross-entropy by the language's median, times its
    own median. Length classes that are as sparse over all languages are joined by their neighbours. Only a calibration
    without any text leaves limits infinite.
    """
    classes = F.lit(-1)
    for low in LENGTHS.tolist():
        classes = classes + (F.col("__letters") >= low).cast("int")
    scored = predictions(calibration.select("text"), model, "text").filter("__letters > 0").select(F.col("__lang").alias("lang"), classes.alias("size"), F.col("__entropy").alias("entropy"))
    scored, path = stored(scored, "calibration")
    near_all = lambda value: F.percentile_approx(value, F.lit(1 - rejected_share), F.lit(100_000))
    # A row a language and length class at most.
    own = {(r.lang, r["size"]): (r.n, r.q) for r in scored.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), near_all("entropy").alias("q")).collect()}
    middle = scored.groupBy("lang").agg(F.percentile_approx("entropy", F.lit(0.5), F.lit(10_000)).alias("middle"))
    middles = {r.lang: r.middle for r in middle.collect()}
    known = scored.sparkSession.createDataFrame(list(middles.items()), "of string, middle double")
    ratios = scored.join(F.broadcast(known), F.col("lang") == F.col("of")).groupBy("size").agg(F.count(F.lit(1)).alias("n"), near_all(F.col("entropy") / F.col("middle")).alias("q"))
    pooled = {r["size"]: (r.n, r.q) for r in ratios.collect()}
    forget(calibration.sparkSession, path)
    langs, enough = model.scorer.langs, 1 / rejected_share
    limits = np.full((len(langs), len(LENGTHS)), np.inf)
    if not pooled:
        return limits
    for size in range(len(LENGTHS)):
        n, ratio = 0, 0.0
        for near in sorted(pooled, key=lambda k: (abs(k - size), k)):
            n, ratio = n + pooled[near][0], max(ratio, pooled[near][1])
            if n >= enough:
                break
        for k, lang in enumerate(langs):
            n, most = own.get((lang, size), (0, 0.0))
            limits[k, size] = most if n >= enough else max(most, ratio * middles.get(lang, max(middles.values())))
    return limits


PREDICTED = ["lang string", "score double", "entropy double", "letters bigint", "rejected boolean"]


def predictions(docs: DataFrame, model: LanguageIdentifier, text_col: str = "text", prefix: str = "__") -> DataFrame:
    """docs with the prediction for each text, in columns of that prefix; nothing but the text enters it."""
    added = T._parse_datatype_string(", ".join(prefix + p for p in PREDICTED))
    schema = T.StructType([*docs.schema.fields, *added.fields])
    names = schema.names
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the number of distinct grams

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, text_col, 500_000):
                texts = part.column(text_col).to_pylist()
                langs, score, entropy, letters, rejected = own.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(score), pa.array(entropy), pa.array(letters, pa.int64()), pa.array(rejected)], names)

    return map_arrow(docs, run, schema)


def bounded_sample(labelled: DataFrame, most_chars: int = LABELLED_CHARS) -> DataFrame:
    """The labelled rows (lang, text), whole texts, of which a language has about most_chars characters at most; by a hash of the
    text, so which rows they are doesn't depend on how the rows are dealt. All rows where they are no more."""
    total = labelled.groupBy("lang").agg(F.sum(F.length("text").cast("bigint")).alias("chars"))
    shares = {r.lang: most_chars / r.chars for r in total.collect() if (r.chars or 0) > most_chars}  # a row a language
    if not shares:
        return labelled
    share = F.lit(1.0)
    for lang, part in shares.items():
        share = F.when(F.col("lang") == lang, part).otherwise(share)
    return labelled.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))


def split_and_train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_chars: int = LABELLED_CHARS) -> LanguageIdentifier:
    """Counts a bounded sample of folds 0 and 3, calibrates on fold 1; fold 2 is never seen."""
    rows = docs.select(fold(F.col(id_col)).alias("fold"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    return train(bounded_sample(rows.filter("fold IN (0, 3)").select("lang", "text"), most_chars), rows.filter("fold = 1"))


def op1_language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = split_and_train(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predictions(rows, model).select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"), F.col("__entropy").alias("entropy"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their columns."""
    prefix = free_prefix(docs.columns)
    return predictions(docs, split_and_train(docs), prefix=prefix).filter(~F.col(f"{prefix}rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))
