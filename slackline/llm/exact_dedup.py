"""Exact deduplication with Patricia tries that own partitions of texts.

1. Each input partition inserts its texts' bytes into a trie of its own, which combines copies before anything
   is shuffled: what leaves is one text per class and partition, with the count and the identifier that stays.
   Each row keeps the name of its representative.
2. Representatives go to owners by (length, content hash). An owner takes one bucket of them at a time, inserts
   the full byte strings into a trie and reads off, at each terminal, the class's identifier and size.
3. Rows get their class by joining on their representative, whose rows all lie in one input partition: a class
   that holds a third of all rows meets no hot key.

Owners hold a class's representatives, one for each input partition, never its rows. A trie over its memory budget
spills by subtree: the heaviest one below the first fork goes to a task-private file,
what arrives for it later is appended, and it is finished by itself when the rest is done.

Contract: a null text counts as empty; empty texts are equal; a null identifier loses to any other; repeated
identifiers are rows of their own; an empty table gives no rows; the texts of any length are compared whole.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.llm import shared

#: Bytes of text that a trie holds before it spills a subtree.
TRIE_BYTES = 128 << 20
#: Buckets of (length, content hash), one for each ``BUCKET_BYTES`` of the written texts at least; an owner holds one at a time.
BUCKETS, BUCKET_BYTES = 1 << 16, 4 << 20


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.value, self.children = label, value, {}


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling and halving with whole comparisons."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while low + step < n and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(n, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """Byte strings to values in a radix tree with compressed paths; ``merge(old, new)`` joins values of equal ones.

    ``settled(new, held)`` is called for each value once its terminal is in memory, with what that holds then: at
    once, or when a spilled subtree is finished.
    """

    def __init__(self, merge, budget: int = TRIE_BYTES, settled=None):
        self.merge, self.budget, self.settled = merge, budget, settled
        self.root, self.held = _Node(b""), 0
        self.spilled: dict[bytes, object] = {}  # prefix: file with what follows it
        self.lengths: list[int] = []  # of prefixes that were spilled

    def add(self, key: bytes, value, known: bool = False) -> None:
        """``known``: the value was settled before."""
        for n in self.lengths:
            if (f := self.spilled.get(key[:n])) is not None and n <= len(key):
                pickle.dump((key[n:], value, known), f)
                return
        node, rest, held = self.root, key, value
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = _Node(rest, value)
                self.held += len(rest) + 200
                break
            label = child.label
            if rest.startswith(label):
                node, rest = child, rest[len(label) :]
                continue
            n = _common(label, rest)
            middle = _Node(label[:n])
            node.children[rest[0]] = middle
            child.label = label[n:]
            middle.children[child.label[0]] = child
            self.held += 200
            node, rest = middle, rest[n:]
        else:
            node.value = held = value if node.value is None else self.merge(node.value, value)
        if self.settled and not known:
            self.settled(value, held)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Writes out the heaviest subtree below the first fork; a trie of one string has none and stays."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.value is None and next(iter(node.children.values())).children:
            node = next(iter(node.children.values()))
            prefix += node.label
        if len(node.children) + (node.value is not None) < 2:
            return
        weights = {b: self._weight(c) for b, c in node.children.items()}
        heaviest = max(weights, key=weights.get)
        if len(prefix) + 1 not in self.lengths:
            self.lengths.append(len(prefix) + 1)
        f = self.spilled[prefix + bytes([heaviest])] = tempfile.TemporaryFile(prefix="trie-")
        for key, value in self._walk(node.children.pop(heaviest), b""):
            pickle.dump((key[1:], value, True), f)
        self.held -= weights[heaviest]

    def _weight(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            stack += node.children.values()
        return total

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.value is not None:
                yield key, node.value
            stack += [(c, key) for c in node.children.values()]

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All keys and values, then those of spilled subtrees, each in a trie without its prefix."""
        yield from self._walk(self.root, b"")
        self.root, self.held = _Node(b""), 0
        while self.spilled:
            prefix, f = self.spilled.popitem()
            f.seek(0, os.SEEK_SET)
            below = Trie(self.merge, self.budget, self.settled)
            while True:
                try:
                    key, value, known = pickle.load(f)
                except EOFError:
                    break
                below.add(key, value, known)
            f.close()
            for key, value in below.items():
                yield prefix + key, value


def _better(a: tuple, b: tuple, largest: bool) -> tuple:
    """Of two (id, row number): the id that stays; a null loses, and of equal ids the first row stays."""
    if a[0] is None or b[0] is None or a[0] == b[0]:
        return min(a, b, key=lambda x: (x[0] is None, x[1]))
    return a if (a[0] > b[0]) == largest else b


def _combine(id_kind: str, largest: bool, budget: int):
    """mapInArrow function: each row with its representative; representatives carry text, count and keeper.

    A row leaves as soon as its text has a terminal, so a class costs its text and one value, however many rows it has.
    """

    def merge(old, new):
        return old[0], old[1] + new[1], _better(old[2], new[2], largest)

    def combined(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def batch(rows):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["id", "row", "rep", "text", "n"])

        def member(new, held):
            members.append((*new[2], held[0], None, None))

        def drain():
            """One row of each class, in batches of bounded text, and the members that come to light meanwhile."""
            rows, size = [], 0
            for text, (rep, n, keep) in trie.items():
                rows.append((*keep, rep, text, n))
                size += len(text)
                if size > 8 << 20 or len(rows) + len(members) > 20_000:
                    yield batch(rows + members)
                    members.clear()
                    rows, size = [], 0
            if rows or members:
                yield batch(rows + members)
                members.clear()

        shared.working("exact")
        row, members = TaskContext.get().partitionId() << 33, []
        trie, kind, seen = Trie(merge, budget, member), None, 0
        for b in batches:
            kind = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                trie.add(text, (row, 1, (i, row)))
                row += 1
                seen += len(text) + 64
            if len(members) > 20_000:
                yield batch(members)
                members.clear()
            if seen > 4 * budget:  # a combiner may pass on what it has; owners put classes together
                yield from drain()
                trie, seen = Trie(merge, budget, member), 0
        if kind is not None:
            yield from drain()

    return combined, f"id {id_kind}, row long, rep long, text binary, n long"


def _own(id_kind: str, largest: bool, budget: int):
    """mapInArrow function over representatives in order of bucket: the class of each."""

    def merge(old, new):
        old[2].extend(new[2])  # in place: a class has a representative for each input partition
        return [_better(old[0], new[0], largest), old[1] + new[1], old[2]]

    def owned(batches):
        import pyarrow as pa

        def drain():
            out = [(rep, *keep, n, digest) for text, (keep, n, members) in trie.items() for digest in [hashlib.sha256(text).hexdigest()] for rep in members]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), kind, pa.int64(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["rep", "keep_id", "keep_row", "group_size", "text_sha256"])

        trie, current, kind = Trie(merge, budget), None, None
        for b in batches:
            kind = b.schema.field(1).type
            for bucket, i, row, rep, text, n in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != current and current is not None:
                    yield drain()
                    trie = Trie(merge, budget)
                current = bucket
                trie.add(text, [(i, row), n, [rep]])
        if current is not None:
            yield drain()

    return owned, f"rep long, keep_id {id_kind}, keep_row long, group_size long, text_sha256 string"


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. ``keep``: smallest or largest id.

    Of several rows with the id that stays and equal texts, the first is kept.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    shared.session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    f, schema = _combine(kind, keep == "largest", trie_bytes)
    combined = shared.table(docs.select(id_col, shared.text_or_empty(text).alias("text")).mapInArrow(f, schema), "exact-dedup")
    buckets = max(BUCKETS, shared.written_bytes(combined) // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64(F.octet_length("text"), "text"), F.lit(buckets))
    reps = combined.where("n is not null").select(bucket.alias("bucket"), "id", "row", "rep", "text", "n")
    f, schema = _own(kind, keep == "largest", trie_bytes)
    owned = reps.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(f, schema)
    joined = combined.where("n is null").select("id", "row", "rep").join(owned, "rep")
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each class of equal texts, whatever its other columns."""
    found = classes(docs, id_col, text, keep).where("kept").select(id_col, "text_sha256")
    return shared.one_of_each(docs, found, id_col, text)
