"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its s-mers is that of its first or its last
one. The choice looks at the k-mer alone, not at its neighbours, so the same passage has the same anchors wherever
it stands, and every k - s + 1 successive k-mers hold one at least. An anchor is a hash with its position. The
fingerprint is the set of all distinct anchor hashes, and ``likeness`` the share of common anchors (Jaccard) of two
of them, whatever the texts' length. Only what is written is compact: ``sketch`` takes the smallest hashes, one in
``SHARE`` but ``SKETCH`` at least.

Positions say where two texts agree. ``passages`` matches anchors of equal hashes and joins successive ones that lie
on one diagonal: neighbours overlap, so such a run is a passage that both texts have, and of every common passage no
more than ``K - S`` code points are missed at either end (texts that repeat a passage are matched in order).

``with_next`` pairs each document with the next one in ascending order of ids: ranges of ids are sorted by
themselves, and each hands on its first and last document as boundary records, which are joined afterwards by the
numbers of their ranges. Texts are shuffled once and no task sees them all.

Contract: a null text counts as empty; a text shorter than k is one anchor of its own; the fingerprint of an empty
text is empty, and two empty ones have likeness 1; repeated ids are ordered by a hash of the text; a table of one document has
itself as the next; an empty table gives no rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.llm import shared

S = 8
K = 2 * S
#: Hashes of a written fingerprint: one in SHARE of the distinct anchors, SKETCH at least (or all).
SKETCH, SHARE = 64, 16
#: Code points that are hashed at a time; a longer text goes in pieces that overlap by K - 1.
PIECE = 1 << 18
#: Ranges of ids for each shuffle partition.
RANGES = 2

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` successive values, n a power of two: halves are joined, doubling the length."""
    h, width = _mix((points.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER), 1
    while width < n:
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    return _mix(h)


def _minima(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` successive values."""
    width = 1
    while width < n:
        step = min(width, n - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    return h


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every closed syncmer of at least K values; of one that is shorter, the whole."""
    if len(points) < K:
        if not len(points):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        points = np.concatenate([points, np.full(K - len(points), 0x110000, np.uint32)])  # no code point
        inner = _grams(points, S)
        return _joined(inner[:1], inner[S : S + 1]), np.zeros(1, np.int64)
    hashes, places = [], []
    for at in range(0, len(points) - K + 1, PIECE):
        part = points[at : at + PIECE + K - 1]
        inner = _grams(part, S)
        least, n = _minima(inner, K - S + 1), len(part) - K + 1
        chosen = np.flatnonzero((inner[:n] == least) | (inner[K - S : K - S + n] == least))
        hashes.append(_joined(inner[chosen], inner[chosen + S]))
        places.append(chosen + at)
    return np.concatenate(hashes), np.concatenate(places)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of K-mers from those of their halves."""
    return _mix(left * _MULTIPLIER + (right ^ (right >> np.uint64(31))))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, in order, by their upper 32 bits."""
    return np.unique(hashes >> np.uint64(32))


def sketch(values: np.ndarray) -> np.ndarray:
    """The smallest of distinct hashes in order, the more the more there are."""
    return values[: max(SKETCH, len(values) // SHARE)]


def fingerprint(text: str) -> np.ndarray:
    """All distinct anchor hashes."""
    return distinct(anchors(_code_points(text))[0])


def spelled(values: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash of a fingerprint's sketch."""
    return sketch(values).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes made distinct: each with how often it came before."""
    order = np.argsort(hashes, kind="stable")
    held = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    out = np.empty(len(hashes), np.uint64)
    out[order] = held + (np.arange(len(held)) - np.repeat(first, np.diff(np.append(first, len(held))))).astype(np.uint64) * _MULTIPLIER
    return out


def passages(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """[passage, (start in a, start in b, length)] in order, from both texts' anchors (hashes, positions)."""
    _, i, j = np.intersect1d(_numbered(a[0]), _numbered(b[0]), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    if not len(i):
        return np.zeros((0, 3), np.int64)
    x, y = a[1][i], b[1][j]
    begins = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(x) != np.diff(y))])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(i)) - 1
    return np.stack([x[first], y[first], x[last] - x[first] + K], axis=1)


def longest(found: np.ndarray) -> int:
    return int(found[:, 2].max()) if len(found) else 0


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as many first code points of the next (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, make, schema: str, id_col: str = "doc_id", text: str = "text", finish=lambda df: df) -> DataFrame:
    """``make(id, text, next text)``, a row of ``schema``, for every document; the first follows the last.

    ``finish`` maps these rows, column by column, before they are written.
    """
    spark = shared.session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    rows = docs.select(F.col(id_col).alias("id"), shared.text_or_empty(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    edge = ["first_id", "first_text", "last_id", "last_text"]

    def paired(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, first, held = TaskContext.get().partitionId(), None, None

        def batch(found, ends):
            columns = dict(zip(names, zip(*found))) if found else {c: [None] for c in names}
            n = max(1, len(found))
            columns |= {"part": [part] * n} | dict(zip(edge, ([x] * n for x in ends)))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in types], schema=types)

        types = shared.arrow_schema(f"{schema}, part int, first_id {kind}, first_text string, last_id {kind}, last_text string")
        for b in batches:
            found = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held is None:
                    first = (i, t)
                else:
                    found.append(make(*held, t))
                held = (i, t)
            if found:
                yield batch(found, (None, None, None, None))
        if held is not None:
            yield batch([], (*first, *held))

    every = ordered.mapInArrow(paired, f"{schema}, part int, first_id {kind}, first_text string, last_id {kind}, last_text string")
    done = shared.table(finish(every), "syncmers")
    edges = done.where("last_text is not null").select("part", *edge)  # a row for each range
    around = Window.orderBy("part")  # numbers of ranges alone
    order = edges.select("part").select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(around), F.first("part").over(around)).alias("then"))
    firsts = edges.select(F.col("part").alias("then"), F.col("first_text").alias("next"))
    pairs = edges.select(F.col("part").alias("at"), "last_id", "last_text").join(order, "at").join(firsts, "then")

    def closed(batches):
        import pyarrow as pa

        types = shared.arrow_schema(schema)
        for b in batches:
            found = [make(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), types)] if found else [pa.array([], f.type) for f in types], schema=types)

    joined = finish(pairs.select("last_id", "last_text", "next").mapInArrow(closed, schema))
    return done.where("last_text is null").select(*joined.columns).union(joined)


FIELDS = "id {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, passage_edited long, passage_next long"


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Each document's fingerprint, its edited text's, the likeness to that and to the next document's, and the length
    in code points of the longest passage that it shares with either.

    Without ``texts``, a SHA-256 takes the place of the edited text, and nothing of the texts is written.
    """

    last: list = [None, None]  # the next document's anchors are its own when its turn comes

    def make(i, t, following):
        changed = edited(t, following)
        own = last[1] if t is last[0] else anchors(_code_points(t))
        last[:] = following, anchors(_code_points(following))
        at = own, anchors(_code_points(changed)), last[1]
        own, other, after = (distinct(hashes) for hashes, _ in at)
        return i, len(t), changed, spelled(own), spelled(other), likeness(own, other), likeness(own, after), longest(passages(at[0], at[1])), longest(passages(at[0], at[2]))

    def finish(df):
        return df if texts else df.withColumn("edited_text", F.sha2("edited_text", 256)).withColumnRenamed("edited_text", "edited_sha256")

    kind = docs.schema[id_col].dataType.simpleString()
    return with_next(docs, make, FIELDS.format(kind=kind), id_col, text, finish).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (hexadecimal) and ``anchors`` (arrays of hash and position); no shuffle."""
    shared.session(docs)

    @F.arrow_udf("struct<fingerprint:string,anchors:array<struct<hash:long,position:long>>>")
    def found(texts):
        import pyarrow as pa

        pairs = [anchors(_code_points(t or "")) for t in texts.to_pylist()]
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))
        lists = pa.array([[{"hash": h, "position": p} for h, p in zip(a.view(np.int64).tolist(), b.tolist())] for a, b in pairs], kind)
        return pa.StructArray.from_arrays([pa.array([spelled(distinct(a)) for a, _ in pairs], pa.string()), lists], ["fingerprint", "anchors"])

    name = shared.fresh(docs, "found")
    return docs.withColumn(name, found(F.col(text))).select(*docs.columns, F.col(f"{name}.fingerprint").alias(shared.fresh(docs, "fingerprint")), F.col(f"{name}.anchors").alias(shared.fresh(docs, "anchors")))
