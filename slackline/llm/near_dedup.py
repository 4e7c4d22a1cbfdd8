"""SimHash near-duplicates at a Jaccard similarity, where three bits of 64 are too few.

1. Buckets. Where the texts are, a text's distinct shingles get ``BANDS`` keys, each of ``ROWS`` MinHash values. Texts
   that share a key are in one bucket: at similarity 0.8 all keys differ with a chance of (1 - 0.8^8)^64, 8 in a
   million, and of less above. (Bits of fingerprints can't be keys here: at 0.8 every seventh bit differs, and a key
   that survives that is too short to part a large corpus.) Keys of one text are dropped; the others give one edge for
   each text, never all pairs.
2. Candidate components come from large and small stars. Only their texts are read again: a bitmap of fixed size
   passes the rows that can be among them, so that the other texts aren't shuffled for it.
3. What is similar to its component's smallest digest is joined to it at once. The rest meets all of the component, in
   tiles, and pairs of tiles are tasks of their own: there, SimHash fingerprints of ``WORDS`` 64-bit words are compared bit-sliced, abandoning what passes
   ``RADIUS`` bits. At 0.8 a bit differs with a chance of 0.15 to 0.19, so 80 of 256 is five standard deviations off or
   more; of unrelated texts one pair in a thousand million comes as near.
4. What is near and not yet joined is checked: the similarity is computed exactly, from postings of 64-bit shingle
   hashes. Only pairs of ``least`` or more are links.

Contract: a null text counts as empty; shingles are of lower-case words (A-Z; white space of ASCII), repeats count
once; a text of fewer words than a shingle is one shingle; texts without words are alike; of a component of links the
smallest id stays; an empty table gives no rows; other columns are kept; texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.llm import shared, simhash

SHINGLE_WORDS = 5
LEAST = 0.8
BANDS, ROWS = 64, 8
#: Words of a fingerprint, and the bits in which two may differ before they are abandoned.
WORDS, RADIUS = 4, 80
#: Shingles of a tile, about, counting ``TEXT`` for each text besides.
TILE, TEXT = 1 << 18, 1 << 9
#: Shingles whose MinHash values are computed at a time.
PIECE = 1 << 10
#: Bits of the map of candidates, 1 MB at most.
MAP_BITS = 1 << 23

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_ADDENDS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MIX = _RANDOM.integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes, in order; of a text without words, a zero."""
    found = np.unique(simhash.shingle_hashes(text, words))
    return found if len(found) else np.zeros(1, np.uint64)


def keys(values: np.ndarray) -> np.ndarray:
    """A text's key in each band, from its shingles."""
    low, least = (values >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), PIECE):
        h = _FACTORS[:, None] * low[None, at : at + PIECE]
        h += _ADDENDS[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    h = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).cumsum(axis=1)[:, -1] + np.arange(BANDS, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def link_sets(left: list, right: list, forest: simhash.Forest, least: float) -> None:
    """Joins all pairs of ``least`` similarity between ``left`` and ``right``, lists of (name, shingles, fingerprint)."""
    sizes = np.fromiter((len(s) for _, s, _ in right), np.int64, len(right))
    every, owner = np.concatenate([s for _, s, _ in right]), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(every, kind="stable")
    owner = owner[order]
    hashes, starts = np.unique(every[order], return_index=True)
    counts = np.diff(np.append(starts, len(every)))
    sliced = simhash.Sliced(np.stack([p for *_, p in right]), RADIUS)
    for first in range(0, len(left), 512):
        part = left[first : first + 512]
        place, lane = sliced.near(np.stack([p for *_, p in part]))
        lanes = np.split(lane[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place, minlength=len(part)))[:-1])
        for (name, values, _), near in zip(part, lanes):
            root = forest.find(name)
            near = [j for j in near.tolist() if forest.find(right[j][0]) != root]
            if not near:
                continue
            at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            at = at[hashes[at] == values]
            n, begin = counts[at], starts[at]
            places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[places], minlength=len(right))
            for j in near:
                if common[j] / (len(values) + sizes[j] - common[j]) >= least:
                    forest.join(name, right[j][0])


def _candidates(rows: DataFrame) -> DataFrame:
    """(vertex, component) of the classes ``c`` of texts that share a key with another."""
    keyed = rows.select("c", F.explode("keys").alias("key"))
    stars = shared.table(keyed.groupBy("key").agg(F.min("c").alias("b"), F.max("c").alias("most")).where("b < most").select("key", "b"), "near-stars")  # read again, a hot key is split
    edges = keyed.join(stars, "key").where("c <> b").select(F.col("c").alias("a"), "b").distinct()
    return shared.table(simhash.components(edges), "near-candidates")


def _among(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` can be among ``values`` (vertex): all that are, and few others."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bits = values.select(slot(F.col("vertex")).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    place = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = df.withColumn("slot", slot(F.col(key))).withColumn("bucket", F.bitmap_bucket_number("slot"))
    near = marked.join(F.broadcast(bits), "bucket")
    return near.where(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("long")) != 0).select(*df.columns)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def links(sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between digests that span the components of links; ``sets``: component, digest, set, print, n."""

    @F.arrow_udf("boolean")
    def similar(left, right):
        import pyarrow as pa

        return pa.array([similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= least for a, b in zip(left.to_pylist(), right.to_pylist())], pa.bool_())

    pivots = shared.table(sets.groupBy("component").agg(F.min(F.struct("digest", "set")).alias("pivot")), "near-pivots")  # read again, a hot component is split
    held = sets.join(pivots, "component").select("component", "digest", "set", "print", "n", F.col("pivot.digest").alias("pivot"), similar("set", "pivot.set").alias("near"))
    held = shared.table(held, "near-held")
    dealt = simhash.deal(held, "component", "near", F.col("n") + TEXT, TILE, ["digest", "set", "print"])

    def linked(batches):
        import pyarrow as pa

        forest, current, left, right = simhash.Forest(), None, [], []
        for b in batches:
            for component, digest, values, fingerprint, t1, t2, first in zip(*(c.to_pylist() for c in b.columns)):
                if (component, t1, t2) != current:
                    if left and right:
                        link_sets(left, right, forest, least)
                    current, left, right = (component, t1, t2), [], []
                (left if first else right).append((digest, np.frombuffer(values, np.uint64), np.frombuffer(fingerprint, np.uint64)))
        if left and right:
            link_sets(left, right, forest, least)
        found = forest.edges()
        for i in range(0, len(found), 1 << 14):
            a, b = zip(*found[i : i + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(4 * partitions, "component", "t1", "t2").sortWithinPartitions("component", "t1", "t2").mapInArrow(linked, "a string, b string")
    return found.union(held.where("near and digest <> pivot").select(F.col("digest").alias("a"), F.col("pivot").alias("b"))).distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component of texts of ``least`` similarity, the one with the smallest id."""

    @F.arrow_udf("array<long>")
    def keyed(texts):
        import pyarrow as pa

        shared.working("near_dedup")
        return pa.array([keys(shingles(t, words)) for t in texts.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("struct<set:binary,print:binary>")
    def spelled(texts):
        import pyarrow as pa

        shared.working("near_dedup")
        sets = [shingles(t, words) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([simhash.wide(s, WORDS).tobytes() for s in sets], pa.binary())], ["set", "print"])

    shared.session(docs)
    body = shared.text_or_empty(text)
    rows = shared.table(docs.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("digest"), keyed(body).alias("keys")), "near")
    order = F.struct(F.isnull("id").alias("null"), "id", "digest")
    firsts = shared.table(rows.groupBy("digest").agg(F.min(order).alias("first")), "near-firsts")
    found = _candidates(rows.select(F.xxhash64("digest").alias("c"), "keys"))
    texts = _among(docs.select(F.sha2(body, 256).alias("digest"), body.alias("text")).withColumn("c", F.xxhash64("digest")), "c", found)
    meant = texts.join(found, texts["c"] == found["vertex"]).dropDuplicates(["digest"])  # two digests of one c are two texts
    sets = shared.table(meant.select("component", "digest", spelled("text").alias("s")).select("component", "digest", "s.set", "s.print", (F.octet_length("s.set") / 8).alias("n")), "near-sets")
    of = simhash.components(links(sets, least))
    linked = shared.table(of.join(firsts, of["vertex"] == firsts["digest"]).select("digest", "first", "component"), "near-linked")
    smallest = linked.groupBy("component").agg(F.min("first").alias("first")).select("first")
    stay = firsts.join(linked, "digest", "left_anti").select("first").union(smallest)
    return shared.one_of_each(docs, stay.select("first.id", "first.digest"), id_col, text)
