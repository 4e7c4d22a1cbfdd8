"""Compressed arrays (npz) that tasks write and read at any block of rows.

A member's deflate stream is a row of blocks, each of so many rows and ended by a full flush: a block begins at a byte
and refers to nothing before it. Tasks compress blocks on their own and put them at their places in the file; the
driver knows their sizes and checksums, never their values. Where blocks begin is kept beside the arrays, in
``INDEX``, so a task inflates its own rows alone. Files without that index, of other origin, are streamed: a task
a member, once. Any reader of npz reads both.

The driver holds a size and a checksum for each block of up to ``NPZ_NUMBERS`` numbers: 24 bytes for 8 MB.
``path`` is one that driver and executors see.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zipfile
import zlib

import numpy as np
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.plans import scratch
from slackline.plans.numbering import numbered

#: Rows of a block, and numbers of its widest array, at most.
NPZ_ROWS, NPZ_NUMBERS = 1 << 20, 1 << 20
#: Member of the file that says where blocks begin. It is no array, so copies that a library makes don't pass for an index.
INDEX = "restarts.json"
#: An empty last block, which ends a stream of flushed ones.
_END = b"\x03\x00"
_HEAD = 30  # bytes of a local header before its name


def block_rows(width: int) -> int:
    return max(1, min(NPZ_ROWS, NPZ_NUMBERS // max(1, width)))


def deflated(data: bytes) -> bytes:
    """A part of a deflate stream that stands alone: whole bytes, no references to what came before."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush(zlib.Z_FULL_FLUSH)


# Checksums of joined parts: CRC-32 is a remainder of polynomials over two elements, bits reversed.
_POLYNOMIAL = 0xEDB88320  # fixed value of CRC-32
_ONE = 1 << 31


def _shifted(a: int) -> int:
    return a >> 1 ^ (_POLYNOMIAL if a & 1 else 0)


def _product(a: int, b: int) -> int:
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = _shifted(b)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The checksum of two parts, from theirs and the size of the second: first · x^(8 size) + second."""
    power, base = _ONE, _ONE >> 8
    while size:
        if size & 1:
            power = _product(power, base)
        base = _product(base, base)
        size >>= 1
    return _product(first, power) ^ second


def shapes(path: str) -> dict[str, tuple]:
    """Shape of every array, from the headers alone."""
    out = {}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if name.endswith(".npy"):
                with z.open(name) as f:
                    out[name.removesuffix(".npy")] = _header(f)[0]
    return out


def _header(f):
    """(shape, type) at the head of a stored array."""
    read = {(1, 0): npy.read_array_header_1_0, (2, 0): npy.read_array_header_2_0}[npy.read_magic(f)]
    shape, fortran, kind = read(f)
    if fortran and len(shape) > 1:
        raise ValueError("arrays are stored by rows")
    return shape, kind


def restarts(path: str) -> dict | None:
    """Rows of a block and where blocks begin, by array; None for a file without an index."""
    with zipfile.ZipFile(path) as z:
        return json.loads(z.read(INDEX)) if INDEX in z.namelist() else None


def block_at(path: str, offset: int, shape: tuple, kind) -> np.ndarray:
    """The block of ``shape`` that begins at a byte of the file; nothing else of the file is inflated."""
    size = int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize
    inflate, out = zlib.decompressobj(-15), bytearray()
    with open(path, "rb") as f:
        f.seek(offset)
        while len(out) < size:
            part = inflate.unconsumed_tail or f.read(1 << 16)
            if not part:
                raise ValueError(f"{path} ends inside a block")
            out += inflate.decompress(part, size - len(out))
    return np.frombuffer(bytes(out), kind).reshape(shape)


def streamed(path: str, name: str, step: int):
    """All blocks of ``step`` rows of an array in order; the member is inflated once, as it streams."""
    with zipfile.ZipFile(path) as z, z.open(f"{name}.npy") as f:
        shape, kind = _header(f)
        width = int(np.prod(shape[1:], dtype=np.int64))
        for at in range(0, shape[0], step):
            n = min(step, shape[0] - at)
            data = f.read(n * width * kind.itemsize)
            if len(data) < n * width * kind.itemsize:
                raise ValueError(f"{name} ends before its rows do")
            yield np.frombuffer(data, kind).reshape((n, *shape[1:]))


def read(spark: SparkSession, path: str, columns: dict[str, str], schema: str, numbered_as: str | None = None) -> DataFrame:
    """Arrays of equal length as columns (column: array); ``numbered_as`` is the number of the row.

    With an index, a task reads a block of each array. Without, a task streams each array and blocks meet by number.
    """
    known = shapes(path)
    n = {known[a][0] for a in columns.values()}
    if len(n) > 1:
        raise ValueError(f"arrays of one length are wanted: {', '.join(columns.values())}")
    n = n.pop()
    kinds = dict(c.strip().split(" ") for c in schema.split(","))
    out_schema = ", ".join(f"{c} {kinds[c]}" for c in ([numbered_as] if numbered_as else []) + list(columns))

    def batch(start: int, arrays: dict[str, np.ndarray]):
        import pyarrow as pa

        from slackline.plans.explore import lists_of

        held = {numbered_as: pa.array(np.arange(start, start + len(next(iter(arrays.values())))))} if numbered_as else {}
        for c in columns:
            a = arrays[c]
            held[c] = lists_of(a, np.float64) if a.ndim > 1 else pa.array(a.astype(np.int64 if kinds[c] == "long" else np.float64))
        return held

    index = restarts(path)
    if index is not None and all(a in index for a in columns.values()):
        step = index[next(iter(columns.values()))]["rows"]
        places = {c: (index[a]["at"], known[a][1:], index[a]["kind"]) for c, a in columns.items()}

        def at_once(batches):
            import pyarrow as pa

            for b in batches:
                for i in b.column(0).to_pylist():
                    rows = min(step, n - i * step)
                    held = batch(i * step, {c: block_at(path, at[i], (rows, *rest), kind) for c, (at, rest, kind) in places.items()})
                    yield pa.RecordBatch.from_arrays(list(held.values()), list(held))

        blocks = -(-n // step)
        return spark.range(0, blocks, numPartitions=max(1, blocks)).mapInArrow(at_once, out_schema)

    step = block_rows(max([1, *(known[a][1] for a in columns.values() if len(known[a]) > 1)]))
    names = list(columns)

    def member(batches):
        import pyarrow as pa

        for b in batches:
            for i in b.column(0).to_pylist():
                for block, a in enumerate(streamed(path, columns[names[i]], step)):
                    held = [pa.array([block], pa.int64()), pa.array([names[i]]), pa.array([a.dtype.str]), pa.array([list(a.shape)], pa.list_(pa.int64())), pa.array([a.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(held, ["block", "name", "kind", "shape", "data"])

    def meet(table):
        import pyarrow as pa

        arrays = {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in table.to_pylist()}
        return pa.table(batch(table.column("block")[0].as_py() * step, arrays))

    parts = spark.range(0, len(names), numPartitions=len(names)).mapInArrow(member, "block long, name string, kind string, shape array<long>, data binary")
    return parts.groupBy("block").applyInArrow(meet, out_schema)


def blocks_of(df: DataFrame, order: str, columns: dict[str, tuple[str, int, str]], step: int) -> DataFrame:
    """name, block, size, crc, data: compressed blocks of ``columns`` (column: array, width or 0, type) in order."""

    def packed(table):
        import pyarrow as pa

        table = table.sort_by("__place")
        found = []
        for c, (name, width, kind) in columns.items():
            values = table.column(c).combine_chunks()
            if width and (table.num_rows * width != len(values.flatten()) or values.null_count):
                raise ValueError(f"rows of {name} have {width} numbers each")
            values = values.flatten() if width else values
            if values.null_count:
                raise ValueError(f"{name} has nulls")
            raw = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), kind).tobytes()
            found.append((name, len(raw), zlib.crc32(raw), deflated(raw)))
        names, sizes, crcs, data = zip(*found)
        block = table.column("__place")[0].as_py() // step
        return pa.table({"name": pa.array(names), "block": pa.array([block] * len(names), pa.int64()), "size": pa.array(sizes, pa.int64()), "crc": pa.array(crcs, pa.int64()), "data": pa.array(data, pa.binary())})

    placed = numbered(df.select(*dict.fromkeys([order, *columns])), [order], "__place")
    kept = placed.select("__place", *columns, F.floor(F.col("__place") / step).alias("__block"))
    return kept.groupBy("__block").applyInArrow(packed, "name string, block long, size long, crc long, data binary")


def write(spark: SparkSession, path: str, small: dict[str, np.ndarray], tables: list[tuple[DataFrame, str, dict]]) -> None:
    """An npz file of ``small`` arrays and of columns of tables (rows, their order, {column: (array, width or 0, type)}).

    Blocks are made once and kept in the shared folder; tasks then write them at their places, so one that runs again
    writes the same bytes. The file gets its name when it is whole.
    """
    heads, parts, rows_of = {}, None, {}
    for df, order, columns in tables:
        n = df.count()
        step = block_rows(max(w for _, w, _ in columns.values()))
        made = blocks_of(df, order, columns, step)
        parts = made if parts is None else parts.union(made)
        for name, width, kind in columns.values():
            heads[name] = _npy_head((n, width) if width else (n,), kind)
            rows_of[name] = step, kind
    parts = scratch.table(parts, "npz-blocks") if parts is not None else None
    sizes: dict[str, list] = {name: [] for name in heads}
    if parts is not None:
        for r in parts.select("name", "block", "size", "crc", F.octet_length("data").alias("packed")).orderBy("name", "block").toLocalIterator():
            sizes[r["name"]].append((r["size"], r["crc"], r["packed"]))

    partial = f"{path}.{uuid.uuid4().hex}"
    index, entries, at = {}, [], 0
    with open(partial, "wb") as f:

        def member(name: str, first: bytes, blocks=()) -> list[int]:
            """Header and first part at ``at``, room for blocks, and the end; where the blocks begin."""
            nonlocal at
            head = deflated(first)
            crc, size, packed = zlib.crc32(first), len(first), len(head)
            places, start = [], at + _HEAD + len(name) + 20  # 20 bytes for the long sizes
            for raw, own, held in blocks:
                places.append(start + packed)
                crc, size, packed = joined_crc(crc, own, raw), size + raw, packed + held
            packed += len(_END)
            info = zipfile.ZipInfo(name)
            info.compress_type, info.CRC, info.file_size, info.compress_size, info.header_offset = zipfile.ZIP_DEFLATED, crc, size, packed, at
            local = info.FileHeader(zip64=True)
            assert at + len(local) == start
            f.seek(at)
            f.write(local + head)
            f.seek(start + packed - len(_END))
            f.write(_END)
            entries.append(info)
            at = start + packed
            return places

        for name, a in small.items():
            a = np.asarray(a)
            member(f"{name}.npy", _npy_head(a.shape, a.dtype.str) + np.ascontiguousarray(a).tobytes())
        for name, head in heads.items():
            step, kind = rows_of[name]
            index[name] = {"rows": step, "kind": np.dtype(kind).str, "at": member(f"{name}.npy", head, sizes[name])}
        member(INDEX, json.dumps(index).encode())
        f.seek(at)
        f.write(_directory(entries, at))

    try:
        places = [(name, i, place) for name, found in index.items() for i, place in enumerate(found["at"])]
        if places:
            where = spark.createDataFrame(places, "name string, block long, at long")

            def put(batches):
                for b in batches:
                    f = os.open(partial, os.O_WRONLY)
                    try:
                        for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                            done = 0
                            while done < len(data):
                                done += os.pwrite(f, data[done:], at + done)
                        os.fsync(f)
                    finally:
                        os.close(f)
                    yield b.slice(0, 0).select(["at"])

            parts.join(where, ["name", "block"]).select("at", "data").mapInArrow(put, "at long").count()
        os.replace(partial, path)
    except BaseException:
        os.unlink(partial)
        raise


def _npy_head(shape: tuple, kind: str) -> bytes:
    import io

    out = io.BytesIO()
    npy.write_array_header_2_0(out, {"descr": np.dtype(kind).str, "fortran_order": False, "shape": shape})
    return out.getvalue()


def _directory(entries: list[zipfile.ZipInfo], at: int) -> bytes:
    """The archive's directory at byte ``at``, sizes and places in their long form (PKWARE's format, version 4.5)."""
    out = b""
    for e in entries:
        name = e.filename.encode()
        long = struct.pack("<HHQQQ", 1, 24, e.file_size, e.compress_size, e.header_offset)
        date = (e.date_time[0] - 1980) << 9 | e.date_time[1] << 5 | e.date_time[2]
        out += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0, e.compress_type, 0, date, e.CRC, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(long), 0, 0, 0, 0, 0xFFFFFFFF) + name + long
    n, size = len(entries), len(out)
    out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, at)
    out += struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
    return out + struct.pack("<4s4HIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
