"""Removal of byte strings that an earlier document has too, by anchors and suffix sorting induced in memory.

Every ``LENGTH`` bytes that also start in a document with a smaller id are removed; strings are judged on the input.

1. Of exact copies all but the smallest id are settled by their hash; texts go on once.
2. The smallest hash among a window's 16-byte strings is its anchor: equal windows have equal anchors at equal
   places. Of what a window holds beside its anchor, over half is on one side, the side of its place; the anchor's
   name is a hash of it and at least 17 bytes of that side. Names are counted over all documents (packed, by hash),
   and only those that two documents share go on. Anchors alone would do for that, but the more text there is, the
   more documents share some 16 bytes and nothing else.
3. A run of windows with one shared name is a segment of at most 67 bytes. Segments go to shards by name, so
   all windows that could be equal meet. Spark's external sorter hands a shard over in order of names, and a
   shard of any size passes through memory in blocks of whole names. Repeats inside a chunk of documents are
   settled before, by a dict.
4. In a block the suffixes at the anchors are sorted; then suffix tuples and their common-prefix values are induced
   leftward, one byte at a time: the order at a byte follows from the order at the next by one stable partition,
   and a common prefix is one more than the least of those between. Where it reaches ``LENGTH``, windows are equal,
   and those of any but the smallest id are marked.
5. Marks return to their texts' chunk, by the id's place and the text's number among those of the id in the chunk, and
   the bytes that they cover are cut out.

Inside, ids are their places in order (``doc``), so an id may be of any type that has an order. A chunk is chosen by
id and text: texts of one id, or without one, are spread.

A name that over ``HOT`` documents share is dealt window by window instead: the windows are sorted with their ids,
and the first of equal ones is the smallest, so no task holds such a group.

Contract: a null text counts as empty; texts under ``LENGTH`` bytes stay whole; a null id comes after every
other; rows that repeat an id don't remove each other (those that repeat the text too share a chunk); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.llm import shared

LENGTH = 50
ANCHOR = 16
SPAN = LENGTH - ANCHOR + 1  # places of an anchor in a window
#: From this place on a window's larger part is left of its anchor.
MIDDLE = SPAN // 2 + 1
#: Documents that share a name before its windows are dealt one by one.
HOT = 1_000
#: Bytes of text in a chunk, the unit that marks return to.
CHUNK_BYTES = 4 << 20
#: Bytes of text for each shuffle partition, so that tasks don't grow with the table, and partitions at most.
PARTITION_BYTES, PARTITIONS = 8 << 20, 100_000
#: Anchors counted in one bucket, and segments sorted in one block, about.
BUCKET_ANCHORS, BLOCK_ROWS = 1 << 20, 1 << 17
#: Windows handled at a time; their places fit the low bits of a key.
PIECE, PLACE_BITS = 1 << 22, 24

_LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``ANCHOR`` bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < ANCHOR:
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_keys(hashes: np.ndarray) -> np.ndarray:
    """For each window of at most ``PIECE``: 40 bits of its anchor's hash, then the anchor's place. Leftmost of equals."""
    h = hashes & ~_PLACE
    h |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    return h


def runs(data: np.ndarray):
    """(name, first window, windows, anchor's place in it) of all runs, as arrays, piece by piece. A name has 40 bits."""
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        hashes = anchor_hashes(data[at : at + PIECE + LENGTH - 1])
        keys = window_keys(hashes)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        anchor = (keys[first] & _PLACE).astype(np.int64)
        n = np.diff(np.append(first, len(keys)))
        left = np.clip(anchor - first - MIDDLE + 1, 0, n)  # windows whose larger part is left of the anchor come first
        start, n = np.stack([first, first + left], axis=1).ravel(), np.stack([left, n - left], axis=1).ravel()
        beside = np.stack([np.maximum(anchor - MIDDLE, 0), np.minimum(anchor + SPAN - MIDDLE, len(hashes) - 1)], axis=1).ravel()
        some = np.flatnonzero(n)
        start, n, beside, anchor = start[some], n[some], beside[some], np.repeat(anchor, 2)[some]
        name = hashes[beside] ^ hashes[beside] >> np.uint64(31)
        name = hashes[anchor] * np.uint64(0xBF58476D1CE4E5B9) + name + (some & 1).astype(np.uint64)
        name ^= name >> np.uint64(32)
        name *= np.uint64(0xD6E8FEB86659FD93)
        yield (name >> np.uint64(PLACE_BITS)).astype(np.int64), start + at, n, anchor - start


def _names(data: np.ndarray, n_buckets: int):
    """``runs`` with names below 2^32 for each bucket: a name's bucket is the remainder, and 32 bits are the rest."""
    for name, *run in runs(data):
        yield name % (n_buckets << 32), *run


def _five(values: np.ndarray) -> bytes:
    """The low 40 bits of each, five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.int64)


def _count_anchors(n_buckets: int):
    """mapInArrow: (chunk, text) rows in order of chunks to (bucket, chunk, rests of names, documents that have each)."""

    def counted(batches):
        import pyarrow as pa

        def flush():
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = hashes % n_buckets
            order = np.argsort(bucket, kind="stable")
            hashes, counts, bucket = hashes[order] // n_buckets, counts[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts], pa.int64()), pa.array(np.full(len(cuts), current), pa.int64()), pa.array([hashes[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([np.minimum(counts[a:b], 65535).astype("<u2").tobytes() for a, b in zip(cuts, ends)], pa.binary())],
                ["bucket", "chunk", "hashes", "counts"],
            )

        held, current, size = [], None, 0
        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (chunk != current or size > 4 * BUCKET_ANCHORS):
                    yield from flush()
                    held, size = [], 0
                current = chunk
                own = [k for k, *_ in _names(np.frombuffer(text, np.uint8), n_buckets)]
                if own:
                    held.append(np.unique(np.concatenate(own)))
                    size += len(held[-1])
        if held:
            yield from flush()

    return counted, "bucket long, chunk long, hashes binary, counts binary"


def _shared_anchors(n_buckets: int):
    """mapInArrow over a partition in order of buckets: (chunk, shared names, hot ones among them)."""

    def shared_ones(batches):
        import pyarrow as pa

        def answer():
            rests = np.concatenate([h for _, h, _ in held])
            values, inverse = np.unique(rests, return_inverse=True)
            total = np.bincount(inverse, np.concatenate([c for *_, c in held]))
            chunks, both, hot, at = [], [], [], 0
            for chunk, h, _ in held:
                n = total[inverse[at : at + len(h)]]
                at += len(h)
                if (n > 1).any():
                    names = h.astype(np.int64) * n_buckets + current
                    chunks.append(chunk)
                    both.append(_five(names[n > 1]))
                    hot.append(_five(names[n > HOT]))
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(both, pa.binary()), pa.array(hot, pa.binary())], ["chunk", "shared", "hot"])

        held, current = [], None
        for b in batches:
            for bucket, chunk, rests, counts in zip(*(c.to_pylist() for c in b.columns)):
                if held and bucket != current:
                    yield answer()
                    held = []
                current = bucket
                held.append((chunk, np.frombuffer(rests, "<u4"), np.frombuffer(counts, "<u2")))
        if held:
            yield answer()

    return shared_ones, "chunk long, shared binary, hot binary"


SEGMENTS = "anchor long, segment binary, doc long, place int, chunk long, starts binary, row int"
#: ``spans``: pairs of first window and number of windows, as little-endian 64-bit integers.
MARKS = "chunk long, doc long, row int, spans binary"


def _numbered(chunk) -> dict:
    """{(doc, text): number} of a chunk in order; texts of one id are numbered, and so are rows of their own."""
    out, before = {}, None
    for doc, text in sorted(set(zip(chunk.column("doc").to_pylist(), chunk.column("text").to_pylist()))):
        number = number + 1 if doc == before else 0
        out[doc, text], before = number, doc
    return out


def _segments(n_buckets: int):
    """Cogrouped chunk: its documents and its shared names to segments; what is settled in the chunk has no anchor."""

    def segments(left, right):
        import pyarrow as pa
        import xxhash

        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], shared.arrow_schema(SEGMENTS))
        common = np.sort(_from_five(b"".join(right.column("shared").to_pylist())))
        hot = np.sort(_from_five(b"".join(right.column("hot").to_pylist())))
        within = lambda values, among: np.zeros(len(values), bool) if not len(among) else among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values
        chunk = left.column("chunk")[0].as_py()
        first: dict[tuple[bytes, int], list] = {}  # segment and place: smallest document and the starts in its rows
        settled: dict[tuple[int, int], list] = {}  # document and row: spans that an earlier one of the chunk has, neighbours joined
        for (doc, text), row in _numbered(left).items():
            for key, start, n, place in _names(np.frombuffer(text, np.uint8), n_buckets):
                keep = within(key, common)
                key, start, n, place = key[keep], start[keep], n[keep], place[keep]
                for k, s, w, p, h in zip(key.tolist(), start.tolist(), n.tolist(), place.tolist(), within(key, hot).tolist()):
                    for i in range(w) if h else (0,):
                        size = 1 if h else w
                        name = (text[s + i : s + i + size + LENGTH - 1], p - i)
                        if (seen := first.get(name)) is None:
                            at = 1 << 62 | xxhash.xxh64_intdigest(name[0]) >> 2 if h else k
                            first[name] = [at, doc, {row: [s + i]}]
                        elif seen[1] == doc:
                            seen[2].setdefault(row, []).append(s + i)
                        else:
                            spans = settled.setdefault((doc, row), [])
                            if spans and spans[-1][0] + spans[-1][1] == s + i:
                                spans[-1][1] += size
                            else:
                                spans.append([s + i, size])
        rows = [(at, segment, doc, place, chunk, np.array(starts, "<i8").tobytes(), row) for (segment, place), (at, doc, of) in first.items() for row, starts in of.items()]
        rows += [(None, None, doc, 0, chunk, np.array(spans, "<i8").tobytes(), row) for (doc, row), spans in settled.items()]
        types = shared.arrow_schema(SEGMENTS)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)] if rows else [pa.array([], f.type) for f in types], schema=types)

    return segments


def induce(groups: np.ndarray, segments: list[bytes], places: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Marks (row, window) of windows that a row with a smaller document in the same group has too.

    A row's segment has its anchor at ``places``; window j starts at byte j, so its anchor is at places - j in it.
    """
    n = len(segments)
    lengths = np.fromiter(map(len, segments), np.int64, n)
    windows = lengths - LENGTH + 1
    width = SPAN - 1 + LENGTH
    table = np.zeros((n, width), np.uint8)  # column SPAN - 1 is the anchor's first byte
    begin = np.repeat(np.arange(n) * width + SPAN - 1 - places - (np.cumsum(lengths) - lengths), lengths)
    table.ravel()[begin + np.arange(lengths.sum())] = np.frombuffer(b"".join(segments), np.uint8)
    right = np.ascontiguousarray(table[:, SPAN - 1 :])
    order = np.argsort(right.view(f"S{LENGTH}").ravel(), kind="stable")
    order = order[np.argsort(groups[order], kind="stable")]
    same = right[order[1:]] == right[order[:-1]]
    common = np.where(same.all(axis=1), LENGTH, np.argmin(same, axis=1)).astype(np.uint8)
    common[groups[order[1:]] != groups[order[:-1]]] = 0
    prefix = np.concatenate([np.zeros(1, np.uint8), common])  # with the suffix before in the order
    marks = np.zeros((n, SPAN), bool)
    for k in range(SPAN):  # suffixes that start k bytes before the anchor
        if k:
            order, prefix = _step(order, prefix, groups, table[:, SPAN - 1 - k], places >= k)
            if not len(order):
                break
        window = places[order] - k
        owned = (window >= 0) & (window < windows[order])
        first = np.flatnonzero(prefix < LENGTH)
        own_docs = np.where(owned, docs[order], _LAST)
        least = np.repeat(np.minimum.reduceat(own_docs, first), np.diff(np.append(first, len(order))))
        found = owned & (docs[order] > least)
        marks[order[found], window[found]] = True
    return marks


def _step(order, prefix, groups, column, reaches):
    """The order and common prefixes of suffixes one byte longer, from those of the suffixes they extend."""
    kept = np.flatnonzero(reaches[order])
    rows = order[kept]
    if not len(rows):
        return rows, prefix[:0]
    moved = np.argsort(groups[rows] << 8 | column[rows], kind="stable")
    at = kept[moved]
    new = rows[moved]
    out = np.zeros(len(new), np.uint8)
    alike = np.flatnonzero((groups[new[1:]] == groups[new[:-1]]) & (column[new[1:]] == column[new[:-1]])) + 1
    low, high = at[alike - 1] + 1, at[alike] + 1  # the least of prefix[low:high]
    level, reach = prefix, 1
    gap = high - low
    while len(alike):
        done = gap < 2 * reach
        d = np.flatnonzero(done)
        out[alike[d]] = np.minimum(np.minimum(level[low[d]], level[high[d] - reach]) + 1, LENGTH)
        if done.all():
            break
        left = ~done
        alike, low, high, gap = alike[left], low[left], high[left], gap[left]
        level = np.minimum(level[:-reach], level[reach:])
        reach *= 2
    return new, out


def _mark(batches):
    """mapInArrow over a shard in order of (anchor, segment, doc): marks as (chunk, doc, row, spans)."""
    import pyarrow as pa

    types = shared.arrow_schema(MARKS)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    def packed(row, spans):
        return row[4], row[2], row[6], np.array(spans, "<i8").tobytes()

    def starts(row):
        return np.frombuffer(row[5], "<i8").tolist()

    def block(rows):
        _, groups = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        marks = induce(groups.astype(np.int64), [r[1] for r in rows], np.array([r[3] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        spans: dict[int, list] = {}
        for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist()):
            spans.setdefault(r, []).extend((s + b, e - b) for s in starts(rows[r]))
        return [packed(rows[r], x) for r, x in spans.items()]

    held, found, single = [], [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] is None:  # settled already
                found.append((row[4], row[2], row[6], row[5]))
            elif row[0] >> 62:  # one window; the first of equal ones has the smallest document
                if single is not None and single[:2] == row[:2]:
                    if row[2] > single[2]:
                        found.append(packed(row, [(s, 1) for s in starts(row)]))
                else:
                    single = row
            else:
                if len(held) >= BLOCK_ROWS and row[0] != held[-1][0]:
                    found += block(held)
                    held = []
                held.append(row)
        if len(found) > 1 << 15:
            yield table(found)
            found = []
    if held:
        found += block(held)
    if found:
        yield table(found)


def _cut(left, right):
    """Cogrouped chunk: documents and marks to id, n_bytes, n_removed, n_spans and the bytes that stay."""
    import pyarrow as pa

    marks: dict[tuple[int, int], list] = {}
    for *row, spans in zip(*(right.column(c).to_pylist() for c in ("doc", "row", "spans"))) if right.num_rows else ():
        pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
        marks.setdefault(tuple(row), []).extend(zip(pairs[:, 0].tolist(), (pairs.sum(axis=1) + LENGTH - 1).tolist()))
    out, numbers = [], _numbered(left) if left.num_rows else {}
    for doc, text in zip(left.column("doc").to_pylist(), left.column("text").to_pylist()):
        kept, at, end, spans = [], 0, -1, 0
        for a, b in sorted(marks.get((doc, numbers[doc, text]), ())):
            if a > end:
                spans += 1
                kept.append(text[at:a])
            end = max(end, b)
            at = end
        kept = b"".join([*kept, text[at:]])
        out.append((len(text), len(text) - len(kept), spans, kept))
    types = shared.arrow_schema(CUT)
    columns = [pa.array(c, f.type) for c, f in zip(zip(*out), types)] if out else [pa.array([], f.type) for f in types]
    return pa.Table.from_arrays([left.column("id"), *columns], ["id", *types.names])


CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _positions(ids: DataFrame) -> DataFrame:
    """(id, doc): distinct ids with their place in order, nulls last. Ranges are sorted; their sizes' sums are offsets."""
    at = F.monotonically_increasing_id()
    order = [F.isnull("id"), F.col("id")]
    placed = ids.distinct().repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    held = shared.table(placed, "repeats-ids")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as ranges
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(sizes.select("part", before.alias("before")), "part").select("id", (F.col("before") + F.col("place")).cast("long").alias("doc"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay)."""
    spark = shared.session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.encode(shared.text_or_empty(text), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), body.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    place = F.struct(F.isnull("id").alias("null"), F.col("id"))
    names = shared.table(rows.select("id", "digest", size), "repeats-names")
    firsts = shared.table(names.groupBy("digest").agg(F.min(place).alias("first"), F.max("n_bytes").alias("size")), "repeats-firsts")
    long = firsts.where(F.col("size") >= LENGTH)
    copies = names.join(long, "digest").where(place > F.col("first"))
    removed = copies.select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.expr("cast('' as binary)").alias("kept"))
    short = rows.where(F.octet_length("text") < LENGTH).select("id", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept"))

    total = names.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTITIONS, -(-total // PARTITION_BYTES)))
    n_chunks = max(2 * partitions, -(-total // CHUNK_BYTES))
    n_buckets = max(partitions, -(-total // (16 * BUCKET_ANCHORS)))
    chunk = lambda of, digest: F.pmod(F.xxhash64(of, digest), F.lit(n_chunks)).alias("chunk")
    of = long.select(F.col("first.id").alias("first_id"), F.col("digest").alias("first_digest"))
    placed = _positions(of.select(F.col("first_id").alias("id")))
    of = of.join(placed, F.col("first_id").eqNullSafe(F.col("id"))).select(chunk("first_id", "first_digest"), "id", F.col("first_digest").alias("digest"), F.lit(None).cast("binary").alias("text"), "doc")
    # dealt by chunk beside the places, then bucketed: neither finding a text's place nor the two steps below that bring something to the texts shuffle them again, as joins would
    dealt = rows.where(F.octet_length("text") >= LENGTH).select(chunk("id", "digest"), "id", "digest", "text", F.lit(None).cast("long").alias("doc")).union(of).repartition(partitions, "chunk")
    placed = dealt.withColumn("doc", F.max("doc").over(Window.partitionBy("chunk", "id", "digest")))
    unique = placed.where(F.col("text").isNotNull() & F.col("doc").isNotNull()).select("chunk", "id", "doc", "text")
    name, path = f"slackline_repeats_{uuid.uuid4().hex}", shared.scratch_path(spark, "repeats-texts")
    unique.write.bucketBy(partitions, "chunk").sortBy("chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
    shared.forget_at_exit(spark, path)
    texts = spark.table(name)
    texts.schema  # noqa: B018  resolved: the files stay, the catalog needs the name no more
    spark.sql(f"DROP TABLE {name}")

    f, schema = _count_anchors(n_buckets)
    counted = texts.select("chunk", "text").mapInArrow(f, schema)
    f, schema = _shared_anchors(n_buckets)
    common = shared.table(counted.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(f, schema), "repeats-anchors")
    segments = texts.select("chunk", "doc", "text").groupBy("chunk").cogroup(common.groupBy("chunk")).applyInArrow(_segments(n_buckets), SEGMENTS)
    sorted_ = segments.repartition(partitions, F.coalesce("anchor", F.xxhash64("doc", "starts"))).sortWithinPartitions("anchor", "segment", "doc")
    marks = shared.table(sorted_.mapInArrow(_mark, MARKS), "repeats-marks")
    cut = texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_cut, f"id {kind}, {CUT}")
    return cut.union(removed).union(short).withColumnRenamed("id", id_col)
