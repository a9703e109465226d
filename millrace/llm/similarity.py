"""Links between texts whose sets of word shingles are similar, for near-dedup by a similarity and not by fingerprint bits.

Candidates share a band of min-hashes: 24 bands of 4 find a pair at 0.8 with probability 0.999996 and one at 0.9 always but
for one in 10^11. In a band's group every member meets one other, the least by a hash that differs from band to band, so a
group of any size gives one pair a member; members that fail meet the one with most links so far, as
copies resemble their original more than each other, and then once more the least by another hash. The similarity of a pair is computed exactly from the sets.

These rounds leave most groups in one component, where no further pair can matter. The rest is exact: of a group that still
has several components, all members of different ones meet in the join, where their sizes and a sketch of 1024 min-hashes of two
bits sort out what can't be similar before a row is made; those that pass are compared by their sets. A pair at 0.8 fails the
sketch about once in a million. What the join compares grows with the square of the members that aren't linked: texts that share
bands and yet stay just below the similarity, in their thousands, are this method's bad case (README has figures).

Defined results: null texts count as empty; texts without words have no shingles and are similar to none; texts of fewer words than a
shingle are one shingle. A similarity of exactly `least` links. Nodes name texts by 64 bits: repeated rows of one text are one node
and linked by the caller; two texts of one name would be taken for one. Of equally good partners the one of the smaller hash, then
the smaller node, is met first, and which one it is doesn't change the components. A very long text is one set of its distinct
shingles, eight bytes each, in a task at once. Empty tables give no links. Columns besides the ones named aren't read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, slices, stored, utf8_rows
from .components import components
from .hashing import mix

BANDS, ROWS = 24, 4
#: Rounds in which a band's members meet one of them, before components that share a band meet in full.
ROUNDS = 3
#: A sketch has two bits each of 64 times so many min-hashes: words of the lower bits, then words of the upper ones.
SKETCH_WORDS = 16


def flat_sets(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, and how many each text has."""
    sets = [np.unique(h) for h in hashes]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def band_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key a band for each text with shingles: [texts, BANDS]."""
    ends = np.cumsum(counts)
    starts = (ends - counts)[counts > 0]
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), np.uint64(band + 1))
        for row in range(ROWS):
            seed = np.uint64((0x9E3779B97F4A7C15 * (band * ROWS + row + 1)) & (1 << 64) - 1)
            key = mix(key ^ np.minimum.reduceat(mix(flat ^ seed), starts)) if len(starts) else key
        keys[:, band] = key
    return keys


def band_lists(hashes: list[np.ndarray]) -> pa.ListArray:
    """The band keys of each text, none without shingles."""
    flat, counts = flat_sets(hashes)
    ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_keys(flat, counts).view(np.int64).ravel()))


def _set_rows(named: DataFrame, width: int, hashes_of) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = flat_sets([hashes_of(t, width) for t in utf8_rows(part.column("text"))])
                sets = [s.tobytes() for s in np.split(flat, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    return map_arrow(named, run, "node bigint, set binary")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Two bits each of 64 * SKETCH_WORDS min-hashes a non-empty set: [sets, 2 * SKETCH_WORDS]."""
    flat, counts = np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
    starts, out = np.cumsum(counts) - counts, np.zeros((len(sets), 2 * SKETCH_WORDS), np.uint64)
    for k in range(64 * SKETCH_WORDS if sets else 0):
        seed = np.uint64((0xD1B54A32D192ED03 * (k + 1)) & (1 << 64) - 1)
        # The low bits of the least hash are as good as even; the upper ones are mostly zero.
        least, place = np.minimum.reduceat(mix(flat ^ seed), starts), np.uint64(k % 64)
        out[:, k // 64] |= (least & np.uint64(1)) << place
        out[:, SKETCH_WORDS + k // 64] |= ((least >> np.uint64(1)) & np.uint64(1)) << place
    return out


def most_sketch_places(least: float) -> int:
    """Places of two sketches that may differ: what a pair of that similarity has on average, and five deviations more."""
    n, p = 64 * SKETCH_WORDS, (1 - least) * 3 / 4
    return int(np.ceil(n * p + 5 * np.sqrt(n * p * (1 - p))))


def _close(one: DataFrame, two: DataFrame, least: float) -> Column:
    """Whether sizes and sketches of two members let the similarity be reached; the other's columns end in _."""

    def odd(k: int) -> Column:
        return one[f"w{k}"].bitwiseXOR(two[f"w{k}_"])

    differ = reduce(Column.__add__, (F.bit_count(odd(k).bitwiseOR(odd(SKETCH_WORDS + k))) for k in range(SKETCH_WORDS)))
    return (one["size"] >= least * two["size_"]) & (two["size_"] >= least * one["size"]) & (differ <= most_sketch_places(least))


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_") for c in df.columns))


def _sketch_rows(sets: DataFrame) -> DataFrame:
    names = ["of_node", "size", *(f"w{k}" for k in range(2 * SKETCH_WORDS))]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "set"):
                own = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
                words = sketches(own).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(x) for x in own], pa.int64()), *(pa.array(words[:, k]) for k in range(2 * SKETCH_WORDS))], names)

    return map_arrow(sets, run, ", ".join(f"{n} bigint" for n in names))


def _compared(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b, one, two) whose sets are as similar as that."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "one"):
                alike = []
                for x, y in zip(part.column("one").to_pylist(), part.column("two").to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    alike.append(common >= least * (len(p) + len(q) - common))
                yield part.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return map_arrow(pairs, run, "a bigint, b bigint")


def _alike(close: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, str]:
    """The pairs (a, b) that are similar, stored; each pair's sets are together for that alone."""
    one = sets.select(F.col("node").alias("x"), F.col("set").alias("one"))
    two = sets.select(F.col("node").alias("y"), F.col("set").alias("two"))
    half, at_half = stored(close.join(one, close["a"] == one["x"]).select("a", "b", "one"), "band-half")
    out, path = stored(_compared(half.join(two, half["b"] == two["y"]).select("a", "b", "one", "two"), least), "band-alike")
    forget(close.sparkSession, at_half)
    return out, path


def _closest(pairs: DataFrame, sketched: DataFrame, least: float) -> tuple[DataFrame, str]:
    """The pairs (a, b) that sizes and sketches don't rule out, stored; only their sets are sent around."""
    other = _renamed(sketched)
    half, at_half = stored(pairs.join(sketched, pairs["a"] == sketched["of_node"]).drop("of_node"), "band-sketched")
    out, path = stored(half.join(other, (half["b"] == other["of_node_"]) & _close(half, other, least)).select("a", "b"), "band-close")
    forget(pairs.sparkSession, at_half)
    return out, path


def _degrees(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("of_node")).union(links.select("b"))
    return both.groupBy("of_node").agg(F.count(F.lit(1)).alias("degree"))


def _firsts(ranked: DataFrame, turn: int) -> DataFrame:
    """(of, first): of each band met twice the member that the others meet; ranked: (node, band, degree)."""
    by = F.struct(F.coalesce(-F.col("degree"), F.lit(0)).alias("d"), F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node")
    groups = ranked.groupBy("band").agg(F.min(by).alias("first"), F.min("node").alias("low"), F.max("node").alias("high"))
    return groups.filter("low <> high").select(F.col("band").alias("of"), F.col("first.node").alias("first"))


def _across(shared: DataFrame, links: DataFrame, sketched: DataFrame, least: float) -> tuple[DataFrame, list[str]]:
    """(a, b) in one band but in different components of the links, that size and sketch don't rule out. And scratch paths."""
    gone = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out, path = stored(df, tag)
        gone.append(path)
        return out

    roots = keep(components(links), "band-roots").withColumnsRenamed({"node": "of_node"})
    rooted = keep(shared.join(roots, shared["node"] == roots["of_node"], "left").select("node", "band", F.coalesce("root", "node").alias("root")), "band-rooted")
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(F.col("band").alias("of"))
    several = keep(several, "band-several")
    rest = keep(rooted.join(several, rooted["band"] == several["of"], "left_semi").distinct(), "band-rest")
    # A node has BANDS bands at most.
    nodes = keep(rest.groupBy(F.col("node").alias("w")).agg(F.collect_set("band").alias("bands")), "band-nodes")
    own = keep(sketched.join(nodes, sketched["of_node"] == nodes["w"]).drop("w"), "band-own")
    members = keep(rest.join(own, rest["node"] == own["of_node"]).drop("of_node"), "band-members")
    other = _renamed(members)
    first = F.array_min(F.array_intersect(members["bands"], other["bands_"])) == members["band"]
    met = members.join(other, (members["band"] == other["band_"]) & (members["root"] < other["root_"]) & _close(members, other, least) & first)
    return keep(met.select(F.col("node").alias("a"), F.col("node_").alias("b")), "band-across"), gone


def similar_links(named: DataFrame, bands: DataFrame, width: int, least: float, hashes_of) -> DataFrame:
    """(a, b) that connect all nodes with a similarity of `least` or more; named: (node, text), hashes_of(text, width) its
    shingle hashes; bands: (node, bands), their band_lists."""
    spark = named.sparkSession
    members, at_members = stored(bands.select("node", F.explode("bands").alias("band")), "bands")
    groups, at_groups = stored(_firsts(members.withColumn("degree", F.lit(0).cast("bigint")), 0), "band-firsts")
    shared, at_shared = stored(members.join(groups, members["band"] == groups["of"]).select("node", "band", "first"), "bands-shared")
    wanted, at_wanted = stored(shared.select(F.col("node").alias("w")).distinct(), "band-wanted")
    forget(spark, at_members, at_groups)
    sets, at_sets = stored(_set_rows(named.join(wanted, named["node"] == wanted["w"], "left_semi").select("node", "text"), width, hashes_of).dropDuplicates(["node"]), "band-sets")
    sketched, at_sketched = stored(_sketch_rows(sets), "band-sketches")
    forget(spark, at_wanted)
    met, at_met, found = shared.filter("node <> first"), None, []
    for turn in range(ROUNDS):
        pairs, at_pairs = stored(met.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "band-pairs")
        close, at_close = _closest(pairs, sketched, least)
        alike, _ = _alike(close, sets, least)
        forget(spark, at_pairs, at_close)
        found.append(alike)
        if turn == ROUNDS - 1:
            break
        held = alike.select(F.col("a").alias("a_"), F.col("b").alias("b_"))
        left, at_left = stored(met.join(held, (met["node"] == held["a_"]) & (met["first"] == held["b_"]), "left_anti").select("node", "band"), "bands-left")
        forget(spark, *filter(None, [at_met]))
        if left.isEmpty():
            forget(spark, at_left)
            at_met = None
            break
        gone = [at_left]
        if turn == 0:
            degree, at = stored(_degrees(alike), "band-degrees")
            gone.append(at)
            ranked = shared.join(degree, shared["node"] == degree["of_node"], "left").select("node", "band", "degree")
        else:
            ranked = shared.select("node", "band", F.lit(0).cast("bigint").alias("degree"))
        groups, at = stored(_firsts(ranked, turn + 1), "band-firsts")
        met, at_met = stored(left.join(groups, left["band"] == groups["of"]).filter("node <> first").select("node", "band", "first"), "band-met")
        forget(spark, *gone, at)
    links, at_links = stored(reduce(DataFrame.union, found), "similar-links")
    across, gone = _across(shared.select("node", "band"), links, sketched, least)
    last, at_last = _alike(across, sets, least)
    every, _ = stored(links.union(last), "similar-links")
    forget(spark, *filter(None, [at_met]), *gone, at_shared, at_sets, at_sketched, at_links, at_last)
    return every
