"""Sharding by histogram sort: shards of near equal bytes, cut at splitters of one global order.

Rows are ordered by a hash of their text, then by a hash of their id, so copies of a text are neighbours. For
each wanted splitter a range of keys is divided by probes, the exact bytes below every probe are counted over
all partitions, and the range between the two nearest probes is divided again, until a probe is within
tolerance or one text is left. A text that is too heavy to stay whole is divided by the id hash in the same
way. Then all rows are exchanged once, to buckets of bounded rows and bytes of a shard, which gives each row its slot.

Defined cases: a null text has no bytes, so its row weighs 1; repeated rows are rows; equal rows (text and id)
are never divided, as nothing tells them apart; an empty table gives an empty result; other columns are
carried, and columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.texts import without
from tokenledger.session import written

SHARDS = 8
# A splitter may miss its target by this part of a shard.
TOLERANCE = 0.002
# Probes per splitter and round.
PROBES = 256
# Rows and bytes per bucket of the last exchange, about: what is sorted together for the slots.
BUCKET_ROWS = 4096
BUCKET_BYTES = 8 * 1024 * 1024
# Bytes per task of the last exchange, about.
TASK_BYTES = 32 * 1024 * 1024

KEY_BITS = 63
RESULTS = ("size", "shard", "slot")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


def id_key(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 1)


class _Splitter:
    """One cut of the order: rows with (text key, id key) below (at, then) are left of it."""

    def __init__(self, target: int):
        self.target = target
        self.low, self.high = 0, 1 << KEY_BITS  # keys that may hold the cut
        self.below = 0  # bytes left of ``low``
        self.within: int | None = None  # the text key inside which the id keys are searched
        self.cut: tuple[int, int] | None = None

    def step(self) -> int:
        return max(1, -(-(self.high - self.low) // PROBES))

    def place(self, key: int) -> tuple[int, int]:
        return (key, 0) if self.within is None else (self.within, key)

    def refine(self, counts: dict[int, tuple[int, int, int]], tolerance: float) -> None:
        """``counts``: for each interval between probes its bytes, least and greatest key."""
        step, below = self.step(), self.below
        near: list[tuple[int, int]] = [(abs(below - self.target), self.low)]
        chosen = None
        for interval in sorted(counts):
            size, least, most = counts[interval]
            if chosen is None and below + size >= self.target:
                chosen = (interval, below, least, most)
            near.append((abs(below - self.target), least))
            below += size
            near.append((abs(below - self.target), most + 1))
        miss, key = min(near)
        if miss <= tolerance or chosen is None:
            self.cut = self.place(key)
            return
        interval, before, least, most = chosen
        if least < most:
            self.low, self.high = least, most + 1
            self.below = before
        elif self.within is None:
            # One text holds the target: search among its ids.
            self.within, self.low, self.high, self.below = least, 0, 1 << KEY_BITS, before
        else:
            self.cut = self.place(key)


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Cuts for rows of (text_key, id_key, size). Each round is one pass that adds up at most
    (shards - 1) * PROBES counts, which is all that reaches the driver."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = [_Splitter(total * i // shards) for i in range(1, shards)]
    while open_cuts := [i for i, cut in enumerate(cuts) if cut.cut is None]:
        intervals = []
        for i in open_cuts:
            cut = cuts[i]
            key = F.col("text_key" if cut.within is None else "id_key")
            inside = (key >= cut.low) & (key <= cut.high - 1)
            if cut.within is not None:
                inside &= F.col("text_key") == cut.within
            interval = F.expr(f"({'text_key' if cut.within is None else 'id_key'} - {cut.low}L) div {cut.step()}L")
            found = F.struct(F.lit(i).alias("i"), interval.alias("interval"), key.alias("key"))
            intervals.append(F.when(inside, found))
        hits = keys.select("size", F.explode(F.array_compact(F.array(*intervals))).alias("hit"))
        counted = (
            hits.groupBy("hit.i", "hit.interval")
            .agg(F.sum("size").alias("size"), F.min("hit.key").alias("least"), F.max("hit.key").alias("most"))
            .collect()
        )
        for i in open_cuts:
            own = {r["interval"]: (r["size"], r["least"], r["most"]) for r in counted if r["i"] == i}
            cuts[i].refine(own, tolerance * total / shards)
    return sorted(cut.cut for cut in cuts)


def shard_of(text_key_: Column, id_key_: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many cuts a row is not left of."""
    passed = [
        ((text_key_ > at) | ((text_key_ == at) & (id_key_ >= then))).cast("int") for at, then in cuts
    ]
    return sum(passed, F.lit(0)).cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with size, shard and slot, a gapless number within the shard."""
    docs = without(docs, *RESULTS)
    # The row travels as one column, so that its columns meet no others.
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        size_of(F.col("text")).alias("size"),
        text_key(F.col("text")).alias("text_key"),
        id_key(F.col("doc_id")).alias("id_key"),
    )
    keys = written(keyed.select("text_key", "id_key", "size"))
    cuts = splitters(keys, shards, tolerance)
    # Buckets divide the text keys evenly. One that a heavy text, or very long ones, fill is divided further by id
    # keys. A short row counts as if it had its part of a bucket's bytes, so both rows and bytes are bounded; only a
    # row that is longer than a bucket makes a larger one.
    load = F.greatest(F.col("size"), F.lit(BUCKET_BYTES // BUCKET_ROWS))
    total = keys.agg(F.sum(load)).first()[0] or 0
    bits = max(0, (total // BUCKET_BYTES).bit_length())
    coarse = F.shiftright(F.col("text_key"), KEY_BITS - bits)
    per_coarse = keys.groupBy(coarse.alias("coarse")).agg(F.sum(load).alias("n"))
    # At most load / BUCKET_BYTES buckets can be that full, and a join that adaptive execution sizes finds them.
    full = written(
        per_coarse.filter(F.col("n") > 2 * BUCKET_BYTES).select("coarse", F.expr(f"n div {BUCKET_BYTES} + 1").alias("parts"))
    )
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def bucketed(frame: DataFrame) -> DataFrame:
        part = F.coalesce(F.pmod(F.col("id_key"), F.col("parts")), F.lit(0))
        shard = shard_of(F.col("text_key"), F.col("id_key"), cuts).alias("shard")
        joined = frame.join(full, coarse == F.col("coarse"), "left")
        return joined.select(*frame.columns, shard, coarse.alias("at"), part.alias("part"))

    counts = bucketed(keys).groupBy("shard", "at", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket, some thousands of rows of the input each.
    before = "sum(n) over (partition by shard order by at, part rows between unbounded preceding and current row) - n"
    starts = counts.selectExpr("shard", "at", "part", f"{before} as start")
    # As many tasks as the bytes need, whatever the session's number of partitions is; join and slots keep them.
    joined = bucketed(keyed).repartition(tasks, "shard", "at", "part").join(
        starts.hint("shuffle_hash"), ["shard", "at", "part"]
    )
    position = F.expr("row_number() over (partition by shard, at, part order by text_key, id_key, row.doc_id)")
    return joined.select("row", "size", "shard", (F.col("start") + position - 1).alias("slot")).select("row.*", *RESULTS)
