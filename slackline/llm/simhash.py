"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are computed where the texts are; only (id, fingerprint) travels. Equal fingerprints are one class.
A pair of fingerprints with ``RADIUS`` differing bits at most agrees on two whole blocks of five, so each class
goes to one bucket for each of the ten pairs of blocks, and no link can be lost. Buckets of one are dropped.
A bucket is compared bit-sliced: its fingerprints become 64 bit planes of packed lanes; for each of its members
the planes are compared with one word operation for 64 lanes (or more), differences are added in carry-save
counters of two bits and an overflow bit, and a stretch of lanes is left once all of it has overflowed.

Each task joins what it links in a forest and passes on one edge for each vertex, never all pairs. A large bucket
is cut into tiles; pairs of tiles are tasks of their own, so no task holds it. Components come from alternating
large and small stars, with every round's edges written to the shared folder.

Contract: a null text counts as empty; a text without words has fingerprint zero, linked like any other; repeated
ids are rows of their own; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.llm import shared

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Bits of the five blocks; a pair of blocks is a bucket's key.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints in a tile of a bucket.
TILE = 4096


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash of every ``size`` successive words, repeats included; of fewer words, one of them all."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and white space of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] - 1 if len(words) >= size else ends[-1:] - 1
    parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(p, SEED) for p in parts), np.uint64, n)


def fingerprint_text(text: str) -> int:
    """A bit is 1 where it is set in over half of the hashes of the shingles, repeats included."""
    hashes = shingle_hashes(text)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of several words: each takes the majority of the hashes mixed anew."""
    out = np.zeros(words, np.uint64)
    for w in range(words):
        h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (w + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        out[w] = majority(h ^ (h >> np.uint64(31))) if len(h) else 0
    return out


def fingerprint(text: str | Column) -> Column:
    """Column of fingerprints as signed 64-bit integers; null stays null."""

    @F.arrow_udf("long")
    def simhash(texts):
        import pyarrow as pa

        shared.working("simhash")
        out = [None if t is None else fingerprint_text(t) for t in texts.to_pylist()]
        return pa.array([None if x is None else x - (x >> 63 << 64) for x in out], pa.int64())

    return simhash(text)


class Sliced:
    """Fingerprints of one or more 64-bit words as bit planes, one lane each; ``near`` compares others with all lanes.

    Distances are kept in carry-save counters, a plane for each of their bits. They begin so that the top one
    overflows where a distance passes ``radius``.
    """

    #: Words compared at a time, before it is asked whether every lane has overflowed.
    STRETCH = 1 << 12

    def __init__(self, values: np.ndarray, radius: int = RADIUS):
        values = values.reshape(len(values), -1)
        self.n, self.radius, self.words = len(values), radius, values.shape[1]
        lanes = np.zeros((64 * self.words, -(-self.n // 64) * 64), np.uint8)
        lanes[:, : self.n] = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little").T
        self.planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8")

    def near(self, values: np.ndarray) -> np.ndarray:
        """(value's place, lane) of all that differ in ``radius`` bits at most."""
        values = values.reshape(len(values), -1)
        out, bits = [], self.radius.bit_length()
        begin = (1 << bits) - 1 - self.radius
        width = self.planes.shape[1]
        rows = max(1, self.STRETCH // max(1, width))
        for first in range(0, len(values), rows):
            asked = values[first : first + rows]
            for at in range(0, width, self.STRETCH):
                planes = self.planes[:, at : at + self.STRETCH]
                shape = (len(asked), planes.shape[1])
                counters = [np.full(shape, _ALL if begin >> i & 1 else 0, np.uint64) for i in range(bits)]
                over = np.zeros(shape, np.uint64)
                for b in range(64 * self.words):
                    flip = np.uint64(0) - (asked[:, b // 64] >> np.uint64(b % 64) & np.uint64(1))  # all ones where the bit is set
                    carry = flip[:, None] ^ planes[b][None, :]
                    for c in counters:
                        rest = c & carry
                        c ^= carry
                        carry = rest
                    over |= carry
                    if b % 8 == 7 and (over == _ALL).all():
                        break
                else:
                    hits = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
                    i, j = np.nonzero(hits[:, : self.n - at * 64])
                    out.append(np.stack([i + first, j + at * 64]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


_ALL = ~np.uint64(0)


class Forest:
    """Union-find; the smallest member is the root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self):
        return [(x, self.find(x)) for x in list(self.up)]


def link_bucket(values: np.ndarray, others: np.ndarray, forest: Forest) -> None:
    """Joins all pairs within the radius between ``values`` and ``others`` (the same array: inside it)."""
    sliced, joined = Sliced(others), np.arange(len(others))  # lanes that share a number are joined already
    for first in range(0, len(values), 512):
        i, j = sliced.near(values[first : first + 512])
        ends = np.flatnonzero(np.diff(i, append=-1)) + 1
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            lanes = j[start:end]
            _, picked = np.unique(joined[lanes], return_index=True)
            for lane in lanes[picked].tolist():
                forest.join(int(values[first + i[start]]), int(others[lane]))
            joined[lanes] = joined[lanes[0]]


def _keys(fp: Column) -> list[Column]:
    at, blocks = 0, []
    for width in BLOCKS:
        blocks.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    assert at == 64
    return [(F.lit(k).cast("long") * (1 << 32)) + blocks[a] * (1 << 13) + blocks[b] for k, (a, b) in enumerate(combinations(range(5), 2))]


def deal(held: DataFrame, key: str, name: str, size: Column, tile: int, columns: list[str]) -> DataFrame:
    """Rows of groups, dealt to tasks so that each row that isn't ``near`` its group's pivot meets all of the group.

    Rows near the pivot are joined through it and needn't meet each other. What is left over is cut into ``rest`` tiles
    and the group into ``every`` tiles of ``tile`` each, by the sum of ``size``; a task is a pair of them, with rows of
    the first as ``left``. A group whose rows are all near its pivot is dealt to nobody.
    """
    tiles = lambda s: F.ceil(F.sum(s) / tile).cast("int")
    cut = shared.table(held.groupBy(key).agg(tiles(size).alias("every"), tiles(F.when(~F.col("near"), size)).alias("rest")).where("rest > 0"), f"{name}-tiles")  # read again, a hot key is split
    rows = held.join(cut, key)
    place = lambda n: F.pmod(F.xxhash64(*columns[:1]), F.col(n)).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where(~F.col("near")).select(key, *columns, place("rest").alias("t1"), count("every").alias("t2"), F.lit(True).alias("left"))
    right = rows.select(key, *columns, count("rest").alias("t1"), place("every").alias("t2"), F.lit(False).alias("left"))
    return left.union(right)


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints ``fp``.

    Buckets of one go no further. In the others, what is near the bucket's smallest fingerprint is joined to it at once;
    only the rest is compared with all of the bucket, in tiles.
    """
    spark = shared.session(fingerprints)
    keyed = fingerprints.select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key"))
    sizes = shared.table(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("fp").alias("pivot")).where("size > 1"), "simhash-sizes")  # read again, both sides of the join are shuffled and a hot key is split
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= RADIUS
    held = shared.table(keyed.join(sizes, "key").select("fp", "key", "pivot", near.alias("near")), "simhash-held")
    dealt = deal(held, "key", "simhash", F.lit(1), TILE, ["fp"])

    def linked(batches):
        import pyarrow as pa

        forest, current, left, right = Forest(), None, [], []

        def close():
            if left and right:
                link_bucket(*(np.array(x, np.int64).view(np.uint64) for x in (left, right)), forest)

        for b in batches:
            for key, fp, t1, t2, first in zip(*(c.to_pylist() for c in b.columns)):
                if (key, t1, t2) != current:
                    close()
                    current, left, right = (key, t1, t2), [], []
                (left if first else right).append(fp)
        close()
        found = np.array(forest.edges(), np.uint64).reshape(-1, 2).view(np.int64)
        for i in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 16), 0]), pa.array(found[i : i + (1 << 16), 1])], ["a", "b"])

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes of much work aren't merged into one task
    found = dealt.repartition(8 * partitions, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").mapInArrow(linked, "a long, b long")
    stars = held.where("near and fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    return found.union(stars).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no vertex has two parents, or a parent and a child."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (a, b), by alternating large and small stars.

    The component is its smallest vertex (as a signed number). Each step keeps every component together and
    brings it nearer to one star. Minima are written before they are joined, so that a hub's rows are split.
    """
    ends = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = shared.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:  # the number of rounds grows with the logarithm of the longest chain
        if _settled(edges):
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        around = ends(edges)
        least = shared.table(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars-least")
        large = shared.table(around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars-large")
        down = shared.table(large.groupBy("a").agg(F.min("b").alias("m")), "stars-down")  # every b is below its a
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", "m"))
        edges = shared.table(small.where("a <> b").distinct(), "stars")


def _classes(rows: DataFrame) -> DataFrame:
    """``rows`` (id, digest, fp) with ``first``: nulls, id and digest of the first row of its component."""
    order = F.struct(F.isnull("id").alias("null"), "id", "digest")
    firsts = shared.table(rows.groupBy("fp").agg(F.min(order).alias("first")), "simhash-classes")
    of = components(links(firsts.select("fp")))
    labelled = firsts.join(of, firsts["fp"] == of["vertex"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("smallest"))
    return shared.table(labelled.join(smallest, "component").select("fp", F.col("smallest").alias("first")), "simhash-components")


def _rows(docs: DataFrame, id_col: str, text: str, digest) -> DataFrame:
    shared.session(docs)
    body = shared.text_or_empty(text)
    return shared.table(docs.select(F.col(id_col).alias("id"), digest(body).alias("digest"), fingerprint(body).alias("fp")), "simhash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, fp (signed), component_id (the smallest id that links reach)."""
    rows = _rows(docs, id_col, text, lambda body: F.lit(""))
    found = _classes(rows)
    return rows.join(found, "fp").select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int | None = None, least: float | None = None) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id.

    With ``least``, texts link at that Jaccard similarity of their shingles of ``words`` words instead of at
    ``RADIUS`` bits: see ``near_dedup``.
    """
    if least is not None:
        from slackline.llm import near_dedup  # it builds on this module

        return near_dedup.deduplicate(docs, id_col, text, words or near_dedup.SHINGLE_WORDS, least)
    digest = lambda body: F.sha2(body, 256)
    stay = _classes(_rows(docs, id_col, text, digest)).select("first").distinct()
    return shared.one_of_each(docs, stay.select("first.id", "first.digest"), id_col, text)
