"""A visited set as rotating Bloom filters, in front of an exact anti join or instead of it.

A filter's bits are set by Spark: hashes become bit positions, and ``bitmap_construct_agg`` unites those of each block of
32 768 bits before and after the shuffle, so what reaches the driver is the filter itself (its size is fixed by ``capacity`` and
``error``). When a filter holds ``factor * capacity`` hashes the next one begins. Filters go to tasks as broadcasts, within
``MOST_BYTES`` in all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of ``bitmap_construct_agg``.
BLOCK_BITS = 1 << 15
#: What filters may take in a task's memory.
MOST_BYTES = 256 << 20


@dataclass
class Bloom:
    """Hashes (binary, 16 bytes or more) seen so far.

    ``exact``: what no filter holds is new at once, and only the rest is looked up in the exact set, of which only what a filter of
    the looked-up hashes may hold is shuffled; the result is that of the anti join alone. Otherwise what a filter holds counts
    as seen: a share of about ``error`` of new hashes is lost for each filter, but nothing is joined.
    """

    capacity: int = 1 << 20
    error: float = 0.01
    factor: float = 0.9
    exact: bool = True
    filters: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    @property
    def probes(self) -> int:
        return max(1, round(-math.log2(self.error)))

    @property
    def blocks(self) -> int:
        bits = -self.capacity * math.log(self.error) / math.log(2) ** 2
        return max(1, math.ceil(bits / BLOCK_BITS))

    def positions(self, hash_: Column) -> Column:
        """The bits of a hash, as an array: two halves of it, combined."""
        part = lambda at: F.conv(F.hex(F.substring(hash_, at, 7)), 16, 10).cast("long")  # noqa: E731  56 bits
        bits = F.lit(self.blocks * BLOCK_BITS)
        return F.transform(F.sequence(F.lit(0), F.lit(self.probes - 1)), lambda i: (part(1) % bits + i * (part(8) % bits)) % bits)

    def built(self, hashes: DataFrame) -> np.ndarray:
        """The filter of a table's ``hash`` column, as 64-bit words."""
        at = hashes.select(F.explode(self.positions(F.col("hash"))).alias("at"))
        rows = at.groupBy(F.floor(F.col("at") / BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg((F.col("at") % BLOCK_BITS)).alias("bits")).collect()  # ``blocks`` rows
        words = np.zeros((self.blocks, BLOCK_BITS // 8), np.uint8)
        for r in rows:
            words[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        return words.ravel()

    def add(self, hashes: DataFrame, n: int) -> None:
        """``n`` more hashes; the next filter begins where the last one is full."""
        if not self.filters or self.held >= self.factor * self.capacity:
            if (len(self.filters) + 1) * self.blocks * BLOCK_BITS // 8 > MOST_BYTES:
                raise ValueError("the filters outgrow a task's memory: use the exact set")
            self.filters.append(np.zeros(self.blocks * BLOCK_BITS // 8, np.uint8))
            self.held = 0
        self.filters[-1] |= self.built(hashes)
        self.held += n

    def may_hold(self, spark, filters: list[np.ndarray]):
        """A column function: whether any of ``filters`` may hold a hash."""
        sent, bits, probes = spark.sparkContext.broadcast(filters), self.blocks * BLOCK_BITS, self.probes

        @F.arrow_udf("boolean")
        def held(hashes):
            import pyarrow as pa

            if not len(hashes):
                return pa.array([], pa.bool_())
            raw = np.frombuffer(b"".join(h[:14] for h in hashes.to_pylist()), np.uint8).reshape(-1, 14).astype(np.uint64)
            scale = np.uint64(256) ** np.arange(6, -1, -1, dtype=np.uint64)
            one, two = ((part * scale).sum(axis=1) % np.uint64(bits) for part in (raw[:, :7], raw[:, 7:]))
            at = (one[:, None] + np.arange(probes, dtype=np.uint64) * two[:, None]) % np.uint64(bits)
            out = np.zeros(len(at), bool)
            for f in sent.value:
                out |= (f[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
            return pa.array(out)

        return held

    def unseen(self, candidates: DataFrame, seen: DataFrame) -> DataFrame:
        """The rows of ``candidates`` (with distinct hashes) that are not in ``seen``, the exact set."""
        from slackline.plans import scratch

        spark = candidates.sparkSession
        told = candidates.withColumn("__held", self.may_hold(spark, self.filters)(F.col("hash")))
        if not self.exact:
            return told.where(~F.col("__held")).drop("__held")
        told = scratch.table(told, "visited-told")
        doubtful = told.where("__held")
        looked_up = self.built(doubtful.select("hash"))
        near = seen.where(self.may_hold(spark, [looked_up])(F.col("hash")))
        return told.where(~F.col("__held")).union(doubtful.join(near, "hash", "left_anti").select(told.columns)).drop("__held")
