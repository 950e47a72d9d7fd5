"""Near-duplicates by MinHash bands, with candidates verified by odd sketches and then by full shingle sets.

1. A text becomes its set of distinct five-word shingles, 64-bit hashes. From the set come MinHash values, in
   bands; sketches; and a fingerprint. Texts with equal sets are one class, and its least document stands
   for it.
2. Classes that share a band are in one bucket. In each bucket the member that shares most buckets is the
   leader, and every member is paired with it, so a bucket of n members gives n - 1 pairs.
3. An odd sketch folds hashes into a parity bitmap. The first folds MinHash samples (the least hash in each of
   ``SAMPLES`` ranges): the XOR of two bitmaps estimates how many samples differ, of as many as either set has by a
   bitmap of the ranges it reaches. Pairs of at least ``LEAST`` shingles together whose estimate is below the threshold
   by more than it may err go. The second folds the whole set: the XOR has at most as many bits as the sets have
   differing shingles, so pairs with more than sets at the threshold may differ by go, and never a link. It is a floor
   for pairs of a handful of shingles, where an estimate says little, and trims what the first lets through.

   Of 1,500 pairs (400 from a union of 1,280 on) at a similarity of 0.8, and of 300 at 0.75 and at 0.65, by the shingles
   of their union::

       union   lost   estimate, deviations below: most   passed at 0.75: first, second   at 0.65: first
          40      0                              1.0                      0.12,   0.00             0.00
         160      0                              2.2                      0.21,   0.00             0.00
         640      0                              2.6                      0.51,   0.00             0.00
       2,560      0                              3.5                      0.72,   0.94             0.00
       5,120      0                              3.5                      0.71,   1.00             0.00
4. Links are confirmed on the full sets, and components are made of them.
5. Buckets that still hold several components are compared in blocks of about ``BLOCK`` x ``BLOCK`` sketches.
   Pairs across components that pass the sketches are confirmed on full sets like the others. A pair that shares
   several bands comes from the first of them only.

So every pair that shares a band is either in one component already or compared. A pair at the threshold
shares no band with a probability of about 3e-6 at 0.8 and 2e-9 at 0.85. It fails the sketches with less than 1e-6
(DEVIATIONS of a normal error; smaller sets err less), and never if it has fewer than ``LEAST`` shingles together.

Defined cases: null and blank texts have an empty set and are linked with nothing; a text with one to four
words has one shingle, all of them; rows that repeat a doc_id are one document with the shingles of one
of its texts, that of the least hash; a null doc_id is linked with nothing; an empty table gives an empty
result; columns other than doc_id and text are not read, and ``deduplicated`` keeps all columns of its input.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.components import components
from tokenledger.llm.texts import blank_words, computed
from tokenledger.operators.joins import fits_broadcast
from tokenledger.session import written

SHINGLE = 5
BANDS, ROWS = 42, 6
# Ranges of the odd sketch's samples, its bits, and how many standard deviations its estimate may be below the
# threshold, which it is by chance less than once in a million pairs.
SAMPLES, SKETCH_BITS, DEVIATIONS = 1024, 2048, 5.0
# Shingles of both sets from which on the samples are asked.
LEAST = 64
# Where the parts of ``sketches`` lie, in 64-bit words.
_SKETCH_PARTS = (0, SKETCH_BITS // 64, SKETCH_BITS // 32, SKETCH_BITS // 32 + SAMPLES // 64)
# Sketches compared at once.
BLOCK = 512

_RNG = np.random.Generator(np.random.PCG64(20))
_MULTIPLIERS = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_WEIGHTS = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    # bytes.lower() changes A-Z only.
    words = blank_words(data.lower()) if data else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = mixed(total + hashes[i : i + n] * _PLACES[i])
    return np.unique(total)


def bands_of(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of MinHash values."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 2048):
        np.minimum(least, (_MULTIPLIERS * short[start : start + 2048]).min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_WEIGHTS).sum(axis=1, dtype=np.uint64)
    return mixed(keys + _BAND_SEEDS)


def _parity(values: np.ndarray) -> bytes:
    bits = (mixed(values) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def odd_sketch(values: np.ndarray) -> tuple[bytes, int]:
    """The parity bitmap of the samples and how many there are. ``values`` are sorted, so the first in each
    range is its least."""
    ranges = values >> np.uint64(64 - SAMPLES.bit_length() + 1)
    first = np.flatnonzero(np.diff(ranges, prepend=np.uint64(SAMPLES)))
    return _parity(values[first]), len(first)


def sketches(values: np.ndarray) -> tuple[bytes, int]:
    """The parity bitmaps of the whole set and of its samples and the bitmap of the ranges it reaches, one after the
    other, and how many samples there are."""
    sampled, n_samples = odd_sketch(values)
    ranges = (values >> np.uint64(64 - SAMPLES.bit_length() + 1)).astype(np.int64)
    reached = np.packbits(np.bincount(ranges, minlength=SAMPLES) > 0).tobytes()
    return _parity(values) + sampled + reached, n_samples


def could_link(
    differ: np.ndarray, samples: np.ndarray, shingles_: np.ndarray, threshold: float, reached: np.ndarray | None = None
) -> np.ndarray:
    """Whether sketches with ``differ`` unequal bits may be of sets as similar as the threshold, given the sums
    of both sketches' samples and of both sets' shingles, and how many ranges either set reaches; without the last,
    what that number is expected to be, from which it may be far in small sets.

    The similarity is the share of ranges with equal samples among the ranges that either set reaches. The
    bits give the first. It errs as a sample of the union does, and by samples that meet in one bit.
    """
    left = np.maximum(1 - 2 * differ / SKETCH_BITS, 1 / SKETCH_BITS)
    equal = (samples + SKETCH_BITS / 2 * np.log(left)) / 2
    union = shingles_ / (1 + threshold)
    if reached is None:
        reached = SAMPLES * -np.expm1(-union / SAMPLES)
    of_sample = threshold * (1 - threshold) / reached * (1 - reached / np.maximum(union, reached))
    full = 8 * (1 - threshold) * reached / SKETCH_BITS
    of_bits = SKETCH_BITS / 16 * (np.expm1(full) - full) / reached**2
    margin = DEVIATIONS * np.sqrt(of_sample + of_bits)
    return equal / reached >= threshold - margin


def passing(x: np.ndarray, y: np.ndarray, samples: np.ndarray, shingles_: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the rows of two arrays of ``sketches`` may be of sets as similar as the threshold, given the sums
    of both sets' samples and shingles."""
    whole, sampled, ranges = (slice(i, j) for i, j in itertools.pairwise(_SKETCH_PARTS))
    y = np.broadcast_to(y, x.shape)
    may = np.ones(len(x), bool)
    asked = np.flatnonzero(shingles_ >= LEAST)
    if len(asked):
        differ = np.bitwise_count(x[asked, sampled] ^ y[asked, sampled]).sum(axis=1, dtype=np.int64)
        reached = np.bitwise_count(x[asked, ranges] | y[asked, ranges]).sum(axis=1, dtype=np.int64)
        may[asked] = could_link(differ, samples[asked], shingles_[asked], threshold, reached)
    left = np.flatnonzero(may)
    differ = np.bitwise_count(x[left, whole] ^ y[left, whole]).sum(axis=1, dtype=np.int64)
    may[left] = differ * (1 + threshold) <= shingles_[left] * (1 - threshold) + 1e-6
    return may


def fingerprint(values: np.ndarray) -> bytes:
    return struct.pack(">q", len(values)) + xxhash.xxh128_digest(values.tobytes())


def _signature(data: bytes | None) -> dict:
    values = shingles(data)
    if not len(values):
        return {"n_shingles": 0, "fingerprint": None, "bands": [], "sketch": None, "n_samples": 0}
    sketch, n_samples = sketches(values)
    return {
        "n_shingles": len(values),
        "fingerprint": fingerprint(values),
        "bands": bands_of(values).view(np.int64).tolist(),
        "sketch": sketch,
        "n_samples": n_samples,
    }


_SIGNATURE = "n_shingles: long, fingerprint: binary, bands: array<long>, sketch: binary, n_samples: long"


def _order(text: Column) -> Column:
    """By which one of the rows that repeat a doc_id is chosen."""
    return F.xxhash64(text)


def signatures(docs: DataFrame) -> DataFrame:
    signature = computed(_signature, _SIGNATURE, F.col("text").cast("binary")).alias("s")
    return docs.select("doc_id", _order(F.col("text")).alias("text_order"), signature).select("doc_id", "text_order", "s.*")


def _passing(threshold: float):
    """A column: whether two sketches may be of sets as similar as the threshold."""

    @F.arrow_udf("boolean")
    def passes(a: pa.Array, b: pa.Array, samples: pa.Array, shingles_: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint64).reshape(len(s), -1) for s in (a, b))
        return pa.array(passing(x, y, np.asarray(samples), np.asarray(shingles_), threshold))

    return passes


def _sketched(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches pass."""
    side = classes.select("doc_id", "sketch", "n_samples", "n_shingles")
    one = side.toDF("id_a", "sketch_a", "samples_a", "shingles_a")
    two = side.toDF("id_b", "sketch_b", "samples_b", "shingles_b")
    joined = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
    sums = (F.col("samples_a") + F.col("samples_b"), F.col("shingles_a") + F.col("shingles_b"))
    passes = _passing(threshold)("sketch_a", "sketch_b", *sums)
    return joined.filter(passes).select("a", "b")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as the threshold. Sets are made again for their texts only."""
    known = classes.select("doc_id", F.col("fingerprint").alias("expected"))
    # Each side is made distinct before it is shuffled: a document may be in very many pairs.
    sides = [pairs.select(F.col(side).alias("doc_id")).distinct() for side in ("a", "b")]
    wanted = sides[0].unionAll(sides[1]).distinct()
    wanted = written(known.join(wanted, "doc_id").withColumnRenamed("doc_id", "wanted"))
    small = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    chosen = docs.select("doc_id", "text").join(small, F.col("doc_id") == F.col("wanted"))

    def values(data: bytes | None, expected: bytes) -> dict:
        # Ids may repeat with other texts; the one that stands for its class counts.
        found = shingles(data)
        return {"values": found.tobytes() if fingerprint(found) == expected else None}

    made = chosen.select("doc_id", computed(values, "values: binary", F.col("text").cast("binary"), F.col("expected"))["values"].alias("values"))
    sets = written(made.filter(F.col("values").isNotNull()).dropDuplicates(["doc_id"]))
    one, two = sets.toDF("id_a", "set_a"), sets.toDF("id_b", "set_b")

    def linked(a: bytes, b: bytes) -> dict:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return {"linked": 100 * common >= percent * (len(x) + len(y) - common)}

    joined = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
    return joined.filter(computed(linked, "linked: boolean", F.col("set_a"), F.col("set_b"))["linked"]).select("a", "b")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's leader: the one that meets most others."""
    degrees = members.groupBy("doc_id").agg(F.sum(F.col("n_members") - 1).alias("degree"))
    ranked = members.join(degrees.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"))
    leaders = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("minus"))).alias("top"))
    leaders = leaders.select(F.col("band").alias("led"), (-F.col("top.minus")).alias("leader"))
    joined = members.join(leaders, F.col("band") == F.col("led")).filter(F.col("doc_id") != F.col("leader"))
    return joined.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()


def _cross_pairs(members: DataFrame, labels: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of bucket members in different components that pass the sketch, by blocks of each bucket."""
    # Both members of a bucket of two have been compared.
    wide = members.filter(F.col("n_members") > 2).join(labels, F.col("doc_id") == F.col("node"), "left")
    wide = wide.select("band", "nth", "doc_id", "n_members", F.coalesce("component", "doc_id").alias("component"))
    mixed_bands = wide.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed_bands = mixed_bands.filter(F.col("x") != F.col("y")).select("band")
    open_members = wide.join(mixed_bands, "band", "left_semi")
    blocks = F.ceil(F.col("n_members") / BLOCK).cast("int")
    # A member goes to the pairs of its own block with every block.
    mine = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = open_members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"),
        (F.col("mine") <= F.col("other")).alias("first"),
        (F.col("mine") >= F.col("other")).alias("second"),
        "nth",
        "doc_id",
        "component",
    )
    side = classes.select(F.col("doc_id").alias("of"), "sketch", "n_samples", "n_shingles", "bands")
    dealt = dealt.join(side, F.col("doc_id") == F.col("of")).drop("of")

    def compared(batches):
        """Units in order; the rows of one may go over several batches."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch["unit"].to_numpy())) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                rows = batch.iloc[part]
                if held and len(rows) and held[0]["unit"].iat[0] != rows["unit"].iat[0]:
                    yield unit_pairs(pd.concat(held))
                    held = []
                if len(rows):
                    held.append(rows)
        if held:
            yield unit_pairs(pd.concat(held))

    def unit_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        ids, labels_ = rows["doc_id"].to_numpy(), rows["component"].to_numpy()
        bitmaps = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        bands, nth = np.array(rows["bands"].tolist()), rows["nth"].iat[0]
        samples, counts = rows["n_samples"].to_numpy(), rows["n_shingles"].to_numpy()
        first, second = np.flatnonzero(rows["first"]), np.flatnonzero(rows["second"])
        found: list[np.ndarray] = []
        for i in first:
            others = second[(labels_[second] != labels_[i])]
            sums = samples[others] + samples[i], counts[others] + counts[i]
            passed = others[passing(bitmaps[others], bitmaps[i], *sums, threshold)]
            passed = passed[~(bands[passed, :nth] == bands[i, :nth]).any(axis=1)]
            found.append(np.stack([np.minimum(ids[passed], ids[i]), np.maximum(ids[passed], ids[i])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    # Units are bounded, so any number of them may share a task.
    grouped = dealt.repartition("unit").sortWithinPartitions("unit", "doc_id")
    return grouped.mapInPandas(compared, "a long, b long").distinct()


def grouped(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: one row per document, links at ``percent`` / 100 or more."""
    threshold = percent / 100
    made = written(signatures(docs))
    alone = made.filter(F.col("doc_id").isNull())
    made = made.filter(F.col("doc_id").isNotNull())
    # One row per class of equal sets; of rows that repeat an id, one text counts.
    least = F.min_by(F.struct("fingerprint", "n_shingles"), "text_order").alias("least")
    per_doc = written(made.groupBy("doc_id").agg(least).select("doc_id", "least.*"))
    first = per_doc.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("of_class"))
    classes = made.join(first, ["fingerprint"]).filter(F.col("doc_id") == F.col("of_class")).dropDuplicates(["doc_id"])
    classes = written(classes.drop("of_class", "text_order"))
    exploded = classes.select("doc_id", F.posexplode("bands").alias("nth", "band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n_members")).filter(F.col("n_members") > 1)
    members = written(exploded.join(shared.withColumnRenamed("band", "key"), F.col("band") == F.col("key")).drop("key"))

    pairs = written(_sketched(_leader_pairs(members), classes, threshold))
    links = written(_confirmed(pairs, classes, docs, percent))
    labels = components(links)
    cross = _cross_pairs(members, labels, classes, threshold)
    cross = written(cross.join(pairs, ["a", "b"], "left_anti"))
    more = written(_confirmed(cross, classes, docs, percent))
    if not more.isEmpty():
        labels = components(links.unionAll(more))

    classed = first.join(labels, F.col("of_class") == F.col("node"), "left")
    classed = classed.select(F.col("fingerprint").alias("key"), F.coalesce("component", "of_class").alias("component"))
    result = per_doc.join(classed, F.col("fingerprint") == F.col("key"), "left")
    component = F.coalesce("component", "doc_id")
    result = result.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    nameless = alone.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return result.unionAll(nameless)


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stand for their component, all columns kept; of rows that repeat an id one, and every
    row without an id."""
    dropped = grouped(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    # Ids are counted without their texts; only rows of repeated ids are brought together.
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("doc_id").isNotNull())
    repeated = written(repeated.select(F.col("doc_id").alias("gone")))
    gone = dropped.unionAll(repeated).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    once = repeated.join(dropped, "gone", "left_anti")
    again = docs.join(once, docs["doc_id"] == once["gone"], "left_semi")
    row = F.struct(*docs.columns)
    one = again.groupBy("doc_id").agg(F.min_by(row, _order(F.col("text"))).alias("row")).select("row.*")
    return left.unionAll(one)
