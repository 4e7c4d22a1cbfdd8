"""Resampling documents towards a target distribution of hashed n-grams, with a dictionary of distinct features.

1. *Chunks.* Texts are cut into words; a chunk (``CHUNK_BYTES`` of text, whole documents) is written once, as its words and
   the documents as word numbers. Features of a chunk are named by pairs (n-gram, next word), without strings.
2. *Dictionary.* Each chunk sends the string of each distinct feature once, with its count, to the partition that owns
   the string; a frequent feature is one row a chunk, so no key is hot. Owners hold what is distinct (a string's CRC-32 is taken when
   it is first met), return the buckets to the chunks, and add the counts up by bucket.
3. *Gains.* Buckets' totals in the documents and in the target give a gain for each bucket: ``buckets`` rows.
4. *Weights.* A chunk meets its buckets again, and gains are joined to the feature counts of its documents.
5. *Draw.* Scores are weights plus Gumbel noise from the document's id; ranks come from ranges and prefix sums.

Contract: null and empty texts have no words, no features and weight 0; a null id draws noise as the empty string does
and comes last among ties; repeated rows are documents of their own, which are drawn each; an empty table gives no rows; an empty
target gives gains all the same. Other columns are ignored. A document is in one chunk, so a worker's memory grows with the longest one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.llm import shared
from slackline.plans.numbering import numbered

BUCKETS = 10_000
#: Text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Bytes of feature strings, repeats across chunks included, that a partition of the dictionary gets.
OWNER_BYTES = 16 << 20

#: A-Z become a-z; what is below 128 and neither letter nor digit parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_OWNED = "chunk long, owner int, side int, buckets binary, totals array<struct<bucket:int,here:long,target:long>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte planes apart."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _chunks(batches) -> Iterator[tuple]:
    """(rows of ids as Arrow arrays, texts as bytes) of up to ``CHUNK_BYTES``."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for row, t in enumerate(batch.column(1).to_pylist()):
            t = t or b""
            if texts and size + len(t) > CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(batch.column(0)[row : row + 1])
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def chunked(docs: DataFrame, id_col: str | Column, text: str, side: int) -> DataFrame:
    """side, chunk, ids, lengths (words of each document), vocabulary and sequence (word numbers), n_bytes: a row a chunk."""

    def cut(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_chunks(batches)):
            codes: dict[bytes, int] = {}
            rows = [[codes.setdefault(w, len(codes)) for w in words(t)] for t in texts]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            sequence = np.fromiter((c for row in rows for c in row), np.int64, int(lengths.sum()))
            flat = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([side], pa.int32()), pa.array([part << 24 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([_packed(lengths)], pa.binary()), pa.array([zstandard.compress(b" ".join(codes), 3)], pa.binary()), pa.array([_packed(sequence)], pa.binary()), pa.array([sum(map(len, texts))], pa.int64())],
                ["side", "chunk", "ids", "lengths", "vocabulary", "sequence", "n_bytes"],
            )

    rows = docs.select(id_col, F.col(text).cast("binary"))
    return rows.mapInArrow(cut, f"side int, chunk long, ids array<{rows.dtypes[0][1]}>, lengths binary, vocabulary binary, sequence binary, n_bytes long")


class Features:
    """Distinct runs of 1 to ``n`` words of a chunk: the same from the same row, whenever it is read."""

    def __init__(self, vocabulary: bytes, sequence: bytes, lengths: bytes, n: int, owners: int):
        import zstandard

        self.words = zstandard.decompress(vocabulary).split()
        self.lengths, at = _unpacked(lengths), _unpacked(sequence)
        self.bounds = np.cumsum(self.lengths)
        left = np.repeat(self.bounds, self.lengths) - np.arange(len(at))  # words to the document's end, this one included
        deal = np.fromiter((zlib.crc32(w) for w in self.words), np.int64, len(self.words))
        names, self.sizes = at, []
        #: by number of words: names at the places that begin such a run, those places; counts, parts (n-gram, last word) and owners by name
        self.levels: list[tuple] = []
        places, number = np.arange(len(at)), deal
        for k in range(n):
            if k:
                keep = left[places] > k
                places, before = places[keep], names[keep]
                pairs, names, count = np.unique(before * max(1, len(self.words)) + at[places + k], return_inverse=True, return_counts=True)
                parts = np.divmod(pairs, max(1, len(self.words)))
                number = (number[parts[0]] * 31 + deal[parts[1]]) & 0xFFFFFFFFFFFF
            else:
                count, parts = np.bincount(at, minlength=len(self.words)), None
            self.levels.append((names, places, count, parts, (number >> 3) % owners))

    def strings(self) -> list[list[bytes]]:
        out: list[list[bytes]] = []
        for _, _, _, parts, _ in self.levels:
            out.append(self.words if parts is None else [out[-1][i] + b" " + self.words[j] for i, j in zip(parts[0].tolist(), parts[1].tolist())])
        return out

    def blocks(self) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        """Owner, strings and counts, shorter runs first, by name."""
        strings = [s for level in self.strings() for s in level]
        owner, count = (np.concatenate([level[k] for level in self.levels]) for k in (4, 2))
        order = np.argsort(owner, kind="stable")
        edges = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            yield int(owner[order[a]]), [strings[i] for i in order[a:b].tolist()], count[order[a:b]]

    def sums(self, buckets: dict[int, np.ndarray], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document: how many features it has, repeats counted, and their gains' sum."""
        owner = np.concatenate([level[4] for level in self.levels])
        bucket = np.full(len(owner), -1, np.int64)
        for o, found in buckets.items():
            bucket[owner == o] = found
        if (bucket < 0).any():
            raise ValueError("features without a bucket")
        n, total, at = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths), np.int64), 0
        for names, places, count, _, _ in self.levels:
            gain = gains[bucket[at : at + len(count)]]
            at += len(count)
            doc = np.searchsorted(self.bounds, places, "right")
            n += np.bincount(doc, minlength=len(n))
            edge = np.concatenate([[0], np.cumsum(gain[names])])
            where = np.searchsorted(doc, np.arange(len(n) + 1))
            total += edge[where[1:]] - edge[where[:-1]]
        return n, total


def _sent(n: int, owners: int):
    """Rows of chunks to blocks: owner, side, chunk, strings, counts."""

    def send(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for r in batch.to_pylist():
                f = Features(r["vocabulary"], r["sequence"], r["lengths"], n, owners)
                for owner, strings, counts in f.blocks():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([owner], pa.int32()), pa.array([r["side"]], pa.int32()), pa.array([r["chunk"]], pa.int64()), pa.array([zstandard.compress(b"\n".join(strings), 3)], pa.binary()), pa.array([_packed(counts)], pa.binary())],
                        ["owner", "side", "chunk", "strings", "counts"],
                    )

    return send


def _owned(buckets: int):
    """Blocks to their strings' buckets, then one row of totals by bucket: the partition's part of the dictionary."""

    def own(batches):
        import pyarrow as pa
        import zstandard

        schema = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("side", pa.int32()), ("buckets", pa.binary()), ("totals", pa.list_(pa.struct([("bucket", pa.int32()), ("here", pa.int64()), ("target", pa.int64())])))])
        known: dict[bytes, int] = {}
        hashed, counts = np.zeros(1 << 12, np.int64), np.zeros((2, 1 << 12), np.int64)  # by number in ``known``
        for batch in batches:
            for r in batch.to_pylist():
                strings, had = zstandard.decompress(r["strings"]).split(b"\n"), len(known)
                number = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
                if len(known) > len(hashed):
                    more = max(len(known), 2 * len(hashed)) - len(hashed)
                    hashed, counts = np.pad(hashed, (0, more)), np.pad(counts, ((0, 0), (0, more)))
                fresh = np.flatnonzero(number >= had)  # ascending: a block has no string twice
                hashed[number[fresh]] = np.fromiter((zlib.crc32(strings[i]) % buckets for i in fresh.tolist()), np.int64, len(fresh))
                counts[r["side"], number] += _unpacked(r["counts"])
                if r["side"] == 0:
                    yield pa.RecordBatch.from_pylist([{"chunk": r["chunk"], "owner": r["owner"], "side": 0, "buckets": hashed[number].astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes(), "totals": None}], schema)
        if known:
            here, target = (np.bincount(hashed[: len(known)], c[: len(known)], buckets).astype(np.int64) for c in counts)
            rows = [{"bucket": int(b), "here": int(here[b]), "target": int(target[b])} for b in np.flatnonzero(here + target)]
            yield pa.RecordBatch.from_pylist([{"chunk": None, "owner": None, "side": None, "buckets": None, "totals": rows}], schema)

    return own


def bucket_gains(totals: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, here, target, gain = floor(1000 ln of the smoothed ratio of shares); a row for each bucket that has features."""
    sums = totals.groupBy("bucket").agg(F.sum("here").alias("here"), F.sum("target").alias("target"))
    whole = totals.agg(F.coalesce(F.sum("here"), F.lit(0)).alias("all_here"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))  # one row
    double = lambda c: F.col(c).cast("double")
    ratio = (double("target") + 1) * (double("all_here") + buckets) / ((double("here") + 1) * (double("all_target") + buckets))
    return sums.join(F.broadcast(whole)).select("bucket", "here", "target", F.floor(1000 * F.ln(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, weight and place (chunk, row) of each document; weight: the mean gain, rounded down."""
    spark = shared.session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    theirs = chunked(target.withColumn(name := shared.fresh(target, "id"), F.lit(None).cast(kind)), name, target_text, 1)
    held = shared.table(chunked(docs, id_col, text, 0).union(theirs), "importance-chunks", codec="none")
    size = held.agg(F.sum("n_bytes")).first()[0] or 0
    owners = 1 + size * n * (n + 1) // 2 // OWNER_BYTES  # no more bytes than all runs of up to n words have
    cells = "side", "chunk", "lengths", "vocabulary", "sequence"
    blocks = held.select(*cells).mapInArrow(_sent(n, owners), "owner int, side int, chunk long, strings binary, counts binary")
    owned = shared.table(blocks.repartition(owners, "owner").mapInArrow(_owned(buckets), _OWNED), "importance-buckets", codec="none")
    totals = owned.where("totals is not null").select(F.explode("totals").alias("t")).select("t.*")
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(totals, buckets).collect():  # ``buckets`` rows at most
        gains[r["bucket"]] = r["gain"]
    sent = spark.sparkContext.broadcast(gains)

    def weigh(left, right):
        import pyarrow as pa

        out = []
        found = {r["owner"]: np.frombuffer(r["buckets"], "<u2" if buckets <= 1 << 16 else "<u4") for r in right.to_pylist()}
        for r in left.select(["chunk", "lengths", "vocabulary", "sequence"]).to_pylist():
            f = Features(r["vocabulary"], r["sequence"], r["lengths"], n, owners)
            count, total = f.sums(found, sent.value)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            out.append(pa.table([pa.array(f.lengths), pa.array(count), pa.array(weight), pa.array(np.full(len(count), r["chunk"])), pa.array(np.arange(len(count)))], ["n_words", "n_features", "weight", "chunk", "row"]))
        ids = pa.concat_arrays([c.flatten() for c in left.column("ids").chunks])
        return pa.concat_tables(out).add_column(0, "id", ids)

    ours = held.where("side = 0").select("chunk", "ids", "lengths", "vocabulary", "sequence")
    theirs = owned.where("side = 0").select("chunk", "owner", "buckets")
    return ours.groupBy("chunk").cogroup(theirs.groupBy("chunk")).applyInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long, chunk long, row long")


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7
) -> DataFrame:
    """id, n_words, n_features, weight, score, rank: 1, 2, ... for the drawn ``percent`` of documents of ``least_words`` or more; else null."""
    found = weights(docs, target, id_col, text, target_text, n, buckets).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = shared.table(found, "importance-weights")
    large = scored.where(F.col("n_words") >= least_words)
    drawn = percent * large.count() // 100
    keys = {"__score": -F.col("score"), "__null": F.col("id").isNull()}
    ranked = numbered(large.withColumns(keys), ["__score", "__null", "id", "chunk", "row"], "rank").drop(*keys)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    small = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(small).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
