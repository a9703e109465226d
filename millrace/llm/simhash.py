"""SimHash near-dedup with pigeonring candidate filtering.

Fingerprints are 64 bits, cut into m = distance + 1 consecutive segments that form a ring. If two fingerprints differ in
at most t bits, some segment starts a chain whose first l segments differ in at most floor(l * t / m) bits together, for
every l. With m = t + 1 the first segment of that chain is equal and the chain of two differs in at most one bit: that
chain is the join key. One side puts its chain as it is, the other also with each unset bit of the second segment set, so
the equi-join yields pairs that pass the chain test and nothing else; the full Hamming check follows in the join itself.
Only distinct fingerprints meet, so exact copies cost one row, and a pair is taken at its first chain alone.

Defined results: null and empty texts have fingerprint zero and are linked like any others. A row with a null id takes
part but names no component. Repeated rows share fingerprint and component. No rows give no rows. Ties: a component's name is
its least id, and of rows with that id the one of the least text hash stays. Only the two columns named are read, so others may
have any name. A very long text is one row: its words and hashes, some 100 bytes a word, are in a task at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keep_named, map_arrow, slices, stored, text_tag, utf8_rows
from .components import components
from .similarity import band_lists, similar_links

BITS = 64


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of `width` words, repeats included; of all words where there are fewer."""
    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-width])]
    return [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def hash_array(text: bytes, width: int) -> np.ndarray:
    return np.array(shingle_hashes(text, width), np.uint64)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: a bit is 1 if set in over half its shingles' hashes."""
    out = np.zeros((len(hashes), 8), np.uint8)
    for i, own in enumerate(hashes):
        set_bits = np.zeros(BITS, np.int64)
        for k in range(0, len(own), 1 << 16):
            set_bits += np.unpackbits(own[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * set_bits > len(own))
    return out.view(">u8").ravel().astype(np.uint64)


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, width: int, bands: bool = False) -> DataFrame:
    """(doc_id, tag, fp bigint); tag with the id names a row. With bands, also (bands array<bigint>), from the same pass."""
    names = ["doc_id", "tag", "fp"] + ["bands"] * bands

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = [hash_array(t, width) for t in utf8_rows(part.column("text"))]
                own = [part.column("doc_id"), part.column("tag"), pa.array(fingerprints_of(hashes).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, band_lists(hashes)] if bands else own, names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_tag(F.col(text_col)).alias("tag"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, tag bigint, fp bigint" + ", bands array<bigint>" * bands)


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the distance + 1 segments."""
    m = distance + 1
    cuts = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(fp: Column, at: tuple[int, int]) -> Column:
    low, width = at
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _differ(a: Column, b: Column, at: tuple[int, int]) -> Column:
    return F.bit_count(_segment(a.bitwiseXOR(b), at))


def near_links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b) of all distinct fingerprints at most `distance` bits apart; fps: (fp), distinct."""
    if not 1 <= distance <= 7:
        raise ValueError("distance must be 1 to 7: fewer segments than that leave chains too short to select by")
    cut = segments(distance)
    m, fp = len(cut), F.col("fp")
    puts, asks = [], []
    for i in range(m):
        lead, (low, width) = _segment(fp, cut[i]), cut[(i + 1) % m]
        follow = _segment(fp, (low, width))
        puts.append(_chain_key(i, lead, follow, width))
        unset = F.filter(F.array(*(F.lit(1 << k).cast("bigint") for k in range(width))), _is_unset(follow))
        asks.append(F.transform(F.concat(F.array(F.lit(0).cast("bigint")), unset), _with_bit(i, lead, follow, width)))
    put = fps.select(F.col("fp").alias("b"), F.inline(F.array(*puts)))
    ask = fps.select(F.col("fp").alias("a"), F.inline(F.concat(*asks)))
    a, b = F.col("a"), F.col("b")
    lead_differs = [_differ(a, b, cut[i]) for i in range(m)]
    chain_differs = [lead_differs[i] + lead_differs[(i + 1) % m] for i in range(m)]
    first, equal = F.lit(m), F.lit(False)
    for i in reversed(range(m)):
        first = F.when((lead_differs[i] == 0) & (chain_differs[i] <= 1), F.lit(i)).otherwise(first)
        equal = F.when(ask["i"] == i, chain_differs[i] == 0).otherwise(equal)
    # A pair whose chain is equal meets from both sides; one whose chain differs meets once, from the side without the bit.
    near = (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= distance) & (ask["i"] == first) & ((a < b) | ~equal)
    return ask.join(put, (ask["i"] == put["i"]) & (ask["key"] == put["key"]) & near).select("a", "b")


def _chain_key(i: int, lead: Column, follow: Column, width: int) -> Column:
    return F.struct(F.lit(i).alias("i"), F.shiftleft(lead, width).bitwiseOR(follow).alias("key"))


def _is_unset(follow: Column):
    return lambda bit: follow.bitwiseAND(bit) == 0


def _with_bit(i: int, lead: Column, follow: Column, width: int):
    return lambda bit: _chain_key(i, lead, follow.bitwiseOR(bit), width)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int, similarity: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: rows (doc_id, tag, fp), fingerprints (fp, root), components (root, component_id, component_size, first:
    the row of least id, nulls last). With a similarity, texts as similar as that in their shingles are linked as well."""
    spark = docs.sparkSession
    rows, _ = stored(fingerprint_table(docs, id_col, text_col, width, similarity is not None), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    fps, at_fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first, F.count(F.lit(1)).alias("n")), "fingerprint-groups")
    links = near_links(fps.select("fp"), distance)
    if similarity is not None:
        links = links.union(_similar_fingerprints(docs, rows, text_col, width, similarity))
    named, at_named = stored(components(links), "fingerprint-roots")
    rooted, _ = stored(fps.join(named, fps["fp"] == named["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "first", "n"), "fingerprint-rooted")
    roots = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.min("first").alias("first"))
    roots, _ = stored(roots, "fingerprint-components")
    forget(spark, at_fps, at_named)
    return rows, rooted, roots


def _similar_fingerprints(docs: DataFrame, rows: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """(a, b) fingerprints of texts that are similar; texts are named by their hash."""
    named = docs.select(text_tag(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))
    links = similar_links(named, rows.select(F.col("tag").alias("node"), "bands"), width, similarity, hash_array)
    fp_of, _ = stored(rows.groupBy(F.col("tag").alias("t")).agg(F.min("fp").alias("f")), "fingerprint-tags")
    half, _ = stored(links.join(fp_of, links["a"] == fp_of["t"]).select(F.col("f").alias("fa"), "b"), "fingerprint-half")
    return half.join(fp_of, half["b"] == fp_of["t"]).select(F.col("fa").alias("a"), F.col("f").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id, component_size): component_id is the least id reachable over links."""
    rows, rooted, roots = _components(docs, id_col, text_col, width, distance)
    known, _ = stored(rooted.join(roots, rooted["root"] == roots["r"]).select(F.col("fp").alias("known"), "component_id", "component_size"), "fingerprint-known")
    return rows.join(known, rows["fp"] == known["known"]).select("doc_id", "fp", "component_id", "component_size")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 2, similarity: float | None = 0.8) -> DataFrame:
    """One document of each component, that of the least id, with all its columns. Fingerprints alone miss most pairs at a
    similarity of 0.8, whose distance is about 10 bits, so the similarity links by itself."""
    rows, _, roots = _components(docs, id_col, text_col, width, distance, similarity)
    first = roots.select(F.col("first.doc_id").alias("d"), F.col("first.tag").alias("t"))
    times = rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("times"))
    kept, _ = stored(times.join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left_semi"), "fingerprint-kept")
    return keep_named(docs, kept, id_col, text_col)


def op5_simhash_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")
