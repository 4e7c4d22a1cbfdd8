"""Packing documents into as few fixed windows as possible by best-two-fit.

One window is filled at a time: always the longest piece that still fits; then the smallest piece in it is exchanged for
the two unpacked pieces that fill its place and the gap best, if they fill them better. Which pieces of a length are
meant doesn't matter, so the plan is made from the number of pieces of each length alone: at most ``window`` counts
reach the driver, whatever the corpus. A filling that can be repeated with what is left is repeated at once, so a plan
has at most ``window * (1 + ln window)`` fillings. Spark numbers the pieces of a length (numbers within a partition plus
prefix sums of the partitions' counts), and the plan turns a number into a window and an offset: no window function over
pieces, no sort of them, no task that sees a whole length.

Tokens are those of a byte-level BPE tokenizer file. tiktoken finds them from that file's vocabulary and merge order;
slices that its regular expressions refuse (about a million white spaces on end) go to the tokenizers library.

Contract: a null text counts as empty and is one ``stop`` token; longer documents are cut into pieces of ``window`` tokens,
the first one may be shorter; an empty table gives no rows; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.llm import bpe, shared

WINDOW = 2048
STOP_ID = 0
#: Characters of a text that are encoded at a time, up to the next single space between two others.
SLICE_CHARS = 1 << 20

#: Fixed value: how byte-level tokenizer files part a text.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Encoder:
    """Whole texts to little-endian 32-bit ids, as the tokenizers library encodes them without adding special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(bpe.byte_letters())}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        self.path, self.special = path, special
        self.fast = tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def slices(self, text: str):
        """Cut before a single space between two others: a pre-token begins there, whatever stands around."""
        at = 0
        while len(text) - at > SLICE_CHARS and (cut := _CUT.search(text, at + SLICE_CHARS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([self._slice(piece) for piece in self.slices(text)])

    def _slice(self, piece: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(piece, allowed_special="all").astype("<u4", copy=False)
        except ValueError:
            return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


shared.REMEMBERED["best_fit"] = encoder.cache_clear


def _pair(lengths: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two lengths with the greatest sum up to ``room``, of equal sums the one with the longest piece."""
    open_ = lengths[counts > 0]
    longer = open_[open_ < room]
    if not len(longer):
        return None
    at = np.searchsorted(open_, np.minimum(room - longer, longer), "right") - 1
    once = counts[counts > 0][np.searchsorted(open_, longer)] < 2
    at -= (at >= 0) & once & (open_[at] == longer)  # not the same piece twice
    sums = np.where(at >= 0, longer + open_[at], -1)
    best = len(sums) - 1 - int(sums[::-1].argmax())
    return (int(longer[best]), int(open_[at[best]])) if sums[best] > 0 else None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Fillings (pieces by length) with how often each is used, by best-two-fit on the number of pieces of each length."""
    lengths = sorted(n for n, c in counts.items() if c)
    left = np.array([counts[n] for n in lengths], np.int64)
    at = {n: i for i, n in enumerate(lengths)}
    every, out = np.array(lengths, np.int64), []
    open_ = list(lengths)  # those that are left, ascending
    while open_:
        filling: Counter[int] = Counter()
        gap, k = window, len(open_)
        while (k := bisect.bisect_right(open_, gap, 0, k) - 1) >= 0:
            n = open_[k]
            taken = min(int(left[at[n]]), gap // n)
            filling[n] += taken
            gap -= taken * n
        most = Counter(filling)
        if filling.total() > 1 and gap:
            rest = left.copy()
            for n, c in filling.items():
                rest[at[n]] -= c
            least = min(filling)
            pair = _pair(every, rest, gap + least)
            if pair and sum(pair) > least:
                filling[least] -= 1
                filling.update(pair)
                filling = +filling
                most |= filling
        # the same choices are made again while every length has as many pieces as were held at once
        again = min((int(left[at[n]]) - most[n]) // c for n, c in filling.items())
        for n, c in filling.items():
            left[at[n]] -= c * (again + 1)
            if not left[at[n]]:
                del open_[bisect.bisect_left(open_, n)]
        out.append((dict(filling), again + 1))
    return out


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by length and number: from ``number`` on, ``uses`` pieces a window lie at ``offset``, windows from ``first`` on."""
    rows, sequence, used = [], 0, Counter()
    for filling, times in fillings:
        offset = 0
        for n in sorted(filling, reverse=True):
            rows.append((n, used[n], sequence, filling[n], offset))
            used[n] += filling[n] * times
            offset += n * filling[n]
        sequence += times
    names = ("length", "number", "first", "uses", "offset")
    table = np.array(sorted(rows), np.int64).reshape(-1, len(names))
    return dict(zip(names, table.T.copy()))


def placed(table: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of the pieces with these numbers among those of their length."""
    key = table["length"] << 48 | table["number"]
    k = np.searchsorted(key, length << 48 | number, "right") - 1
    window, use = np.divmod(number - table["number"][k], table["uses"][k])
    return table["first"][k] + window, table["offset"][k] + use * length


def encode_pieces(docs: DataFrame, id_col: str, text: str, path: str | None, window: int, stop: int) -> DataFrame:
    """id, piece, start, length, ids (packed), the partition, and the number of the piece among its length's there."""
    path = path or bpe.public_vocabulary("byte_bpe_50k.json")

    def encoded(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        e, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            doc, piece, start, length, ids, number = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                data = np.append(e.encode(t or ""), np.uint32(stop)).astype("<u4", copy=False)
                ends = range((len(data) - 1) % window + 1, len(data) + 1, window)
                for k, end in enumerate(ends):
                    begin = max(0, end - window) if k else 0
                    doc.append(row)
                    piece.append(k)
                    start.append(begin)
                    length.append(end - begin)
                    ids.append(data[begin:end].tobytes())
                    number.append(seen[end - begin])
                    seen[end - begin] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(doc), pa.int32()), pa.array(number, pa.int64())],
                ["id", "piece", "start", "length", "ids", "part", "number"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(encoded, f"id {kind}, piece int, start long, length long, ids binary, part int, number long")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, stop: int = STOP_ID) -> DataFrame:
    """Pieces: id, piece, start, length, ids (packed), sequence_id (from 0, without gaps), offset."""
    return _pack(docs, id_col, text, path, window, stop, F.col("ids"))


def piece_checksums(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, stop: int = STOP_ID) -> DataFrame:
    """The same pieces with a CRC-32 in place of their ids, which are never written then."""
    return _pack(docs, id_col, text, path, window, stop, F.crc32("ids").alias("ids_crc32"))


def _pack(docs, id_col, text, path, window, stop, content) -> DataFrame:
    spark = shared.session(docs)
    pieces = encode_pieces(docs, id_col, text, path, window, stop).select("id", "piece", "start", "length", content, "part", "number")
    held = shared.table(pieces, "best-fit-pieces")
    counts = held.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = shared.table(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "best-fit-bases")
    totals = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    table = spark.sparkContext.broadcast(places(plan(totals, window)))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length, number):
        import pyarrow as pa

        sequence, offset = placed(table.value, length.to_numpy(), number.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    joined = held.join(bases.select("part", "length", "base"), ["part", "length"]).withColumn("p", place(F.col("length"), F.col("base") + F.col("number")))
    name = held.columns[4]
    return joined.select(F.col("id").alias(id_col), "piece", "start", "length", name, "p.sequence_id", "p.offset")
