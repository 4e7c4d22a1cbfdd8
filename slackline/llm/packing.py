"""Packing token sequences by concatenating all documents and cutting fixed windows.

Pass one encodes, counting within each partition where every document starts, and writes the ids once. The
partitions' totals are a few rows; their prefix sums are the partitions' offsets. Pass two adds the offsets:
a document covers the windows from its first to its last token, and becomes one boundary record for each. Only
the last window can be short. The offsets are
written too, so their size is known when the join is planned: while they are few, no row is shuffled.

Contract: a null text counts as empty and is one ``stop`` token; an empty table gives no rows; repeated rows are
packed each; other columns of the input are ignored. The order of documents is that of the input's partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.llm import bpe, shared

WINDOW = 2048
STOP_ID = 1


def encode_in_order(docs: DataFrame, id_col: str, text: str, path: str | None, stop: int) -> DataFrame:
    """id, packed ids with ``stop`` at the end, their number, the partition and the tokens before in it."""
    path = path or bpe.public_vocabulary()
    end = stop.to_bytes(4, "little")

    def encoded(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        e, part, before = bpe.encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [e.encode(t or "") + end for t in batch.column(1).to_pylist()]
            starts = []
            for x in ids:
                starts.append(before)
                before += len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                ["id", "ids", "n", "part", "before"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(encoded, f"id {kind}, ids binary, n long, part int, before long")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, stop: int = STOP_ID) -> DataFrame:
    """Pieces: id, start, length, ids (packed), doc_tokens, sequence_id, offset.

    A sequence is ``window`` tokens; the last one may be shorter and is the only one to be padded.
    """
    pieces = _pieces(docs, id_col, text, path, window, stop, lambda ids, start, n: F.substring(ids, start * 4 + 1, n * 4).alias("ids"))
    return pieces.select(F.col("id").alias(id_col), "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")


def piece_checksums(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, stop: int = STOP_ID) -> DataFrame:
    """The same pieces with a CRC-32 in place of their ids."""
    pieces = _pieces(docs, id_col, text, path, window, stop, lambda ids, start, n: F.crc32(F.substring(ids, start * 4 + 1, n * 4)).alias("ids_crc32"))
    return pieces.select(F.col("id").alias(id_col), "p.start", "p.length", "p.ids_crc32", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")


def _pieces(docs, id_col, text, path, window, stop, content) -> DataFrame:
    shared.session(docs)
    coded = shared.table(encode_in_order(docs, id_col, text, path, stop), "packing-ids")
    totals = coded.groupBy("part").agg(F.sum("n").alias("total"))  # as many rows as partitions
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared.table(totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0).cast("long")).alias("base")), "packing-offsets")
    at = F.col("base") + F.col("before")

    def piece(w):
        start = F.greatest(w * window - at, F.lit(0).cast("long"))
        length = F.least((w + 1) * window - at, F.col("n")) - start
        return F.struct(start.alias("start"), length.alias("length"), content(F.col("ids"), start.cast("int"), length.cast("int")), w.alias("sequence_id"), (at + start - w * window).alias("offset"))

    windows = F.sequence(F.floor(at / window), F.floor((at + F.col("n") - 1) / window))
    return coded.join(offsets, "part").select("id", "n", F.explode(F.transform(windows, piece)).alias("p"))
