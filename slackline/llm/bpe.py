"""BPE encoding and decoding as bounded-lookahead streaming transducers.

**Encoding.** A merge list that is proper (each merge's parts exist before it) works rank by rank. Take two
texts that agree up to position p. A merge moves the border of agreement left only where its left part ends at
that border, and the next such merge has a later rank and a right part that begins with the first one's left
part. ``lookahead`` sums left parts over the heaviest such chain, so a token that ends that far before the end
of what has been read is the same whatever follows. ``Transducer`` emits tokens once they are that stable
and keeps one window of symbols. Pre-tokens are independent of each other: a border between two is stable at
once. Every pre-token goes through the transducer; a bounded memo holds its results for short ones.

**Text.** Normal form, lower case and the classes of characters are the tokenizers library's, not Python's tables:
of ``PLAIN`` characters, none of which combines with another, they are probed from the library once in a process;
slices with others go through its normalizer and pre-tokenizer.

**Decoding.** ``Decoder`` turns ids into bytes and bytes into text with an incremental UTF-8 state machine:
a character cut between two calls waits in the state.

Contract: a null text gives null ids (the query counts it as empty); an empty text gives no ids; texts of any
length keep constant merge state; repeated rows give equal rows; other columns stay as they are.
"""

from __future__ import annotations

import array
import codecs
import functools
import heapq
import json
import re
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.llm import shared

#: Entries of a generation of a memo; two generations are held.
MEMO_ENTRIES = 400_000
#: The transducer's results for pre-tokens of more characters are not remembered.
MEMO_CHARS = 48
#: Characters of a text that are normalised and split at a time, up to the next white space.
SLICE_CHARS = 1 << 16

_NONE = 1 << 62
_WHITE = "\t-\r \x85\xa0  -     　"
_SPACE = re.compile(f"[{_WHITE}]")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a tokenizer file, with the lookahead that its merges need."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "", special: dict[str, int] | None = None):
        self.vocab, self.end, self.special = vocab, end, dict(special or {})
        self.shift = max([1, *vocab.values()]).bit_length()
        self.mask = (1 << self.shift) - 1
        self.pairs: dict[tuple[int, int], int] = {}
        self.symbols: dict[int, int] = {}  # symbols (bytes) of each token
        made: dict[int, tuple[int, int]] = {}
        letters = byte_letters()
        self.start = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + end) for c in letters] if end else self.start
        self.symbols = {i: 1 for i in (*self.start, *self.last) if i is not None}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in self.symbols or v not in self.symbols or w in self.symbols:
                raise ValueError(f"merge {rank} is not proper: {a!r} {b!r}")
            self.pairs[u, v] = rank << self.shift | w
            self.symbols[w] = self.symbols[u] + self.symbols[v]
            made[w] = u, v
        self.longest = max(self.symbols.values(), default=1)
        self.lookahead = self._lookahead(made)

    def _lookahead(self, made: dict[int, tuple[int, int]]) -> int:
        heaviest: dict[int, int] = {}  # by the chain's last left part
        most = 0
        for u, v in self.pairs:
            chain, t = 0, v
            while True:
                chain = max(chain, heaviest.get(t, 0))
                if t not in made:
                    break
                t = made[t][0]
            heaviest[u] = max(heaviest.get(u, 0), chain + self.symbols[u])
            most = max(most, heaviest[u])
        return most

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return cls(model["vocab"], merges, model.get("end_of_word_suffix") or "", special)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges, lowest rank first and left to right."""
        if len(ids) > 64:
            return self._merge_long(ids)
        get, mask = self.pairs.get, self.mask
        keys = [get(p, _NONE) for p in zip(ids, ids[1:])]
        while keys and (best := min(keys)) != _NONE:
            i = keys.index(best)
            ids[i] = best & mask
            del ids[i + 1], keys[i]
            if i:
                keys[i - 1] = get((ids[i - 1], ids[i]), _NONE)
            if i < len(keys):
                keys[i] = get((ids[i], ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n for long pre-tokens."""
        n, get, mask = len(ids), self.pairs.get, self.mask
        ids = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i) for i in range(n - 1) if (k := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            key, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != key:
                continue
            ids[i], ids[j] = key & mask, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (k, i))
            if (h := before[i]) >= 0 and (k := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (k, h))
        return [x for x in ids if x >= 0]


class Transducer:
    """Encodes one pre-token that arrives in pieces; ``held`` is never over a window."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.window = merges.lookahead + max(merges.longest, 256)
        self.held: list[int] = []  # bytes

    def feed(self, data: bytes) -> Iterator[int]:
        """Takes bytes; gives the ids that became stable."""
        m = self.merges
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            while len(self.held) > self.window:  # the last byte could still end the pre-token
                done, limit = 0, self.window - m.lookahead
                for t in m.merge([x for b in self.held[: self.window] if (x := m.start[b]) is not None]):
                    if done + m.symbols[t] > limit:
                        break
                    done += m.symbols[t]
                    yield t
                del self.held[:done]

    def finish(self) -> list[int]:
        """The rest, once the pre-token has ended."""
        if not self.held:
            return []
        ids = [self.merges.start[b] for b in self.held[:-1]] + [self.merges.last[self.held[-1]]]
        self.held = []
        return self.merges.merge([x for x in ids if x is not None])


#: Ranges of characters whose normal form, lower case and class are read from tables; none combines, and their lower case is among them.
PLAIN = "\0-\u012f\u0131-\u0239\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
_OTHER = re.compile(f"[^{PLAIN}]")


class Text:
    """A tokenizer file's normalizer and pre-tokenizer, with tables of ``PLAIN`` characters probed from them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        pieces = lambda t: len(self.split(t))
        plain = [c for c in map(chr, range(0x2100)) if not _OTHER.match(c)]
        blank = [c for c in plain if not pieces(c)]
        self.lower = {ord(c): low for c in plain if c not in blank and (low := self.normal(c)) != c.lower()}
        letters = "".join(re.escape(c) for c in plain if c not in blank and pieces(f"a{c}a") == 1)
        numbers = "".join(re.escape(c) for c in plain if pieces(f"a{c}a") == 3 and pieces(c + "!") == 2)
        white = "".join(map(re.escape, blank))
        # runs of letters, single numbers, clitics, runs of other signs
        self.find = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+").findall
        self.bytes = {ord(c): chr(b) for b, c in enumerate(byte_letters())}

    def words(self, piece: str) -> list[str] | None:
        """Pre-tokens of a slice of ``PLAIN`` characters; of any other, None."""
        if not piece.isascii() and _OTHER.search(piece):
            return None
        return self.find(piece.translate(self.lower).lower() if self.lower else piece.lower())

    def spelled(self, piece: str) -> list[str]:
        """Pre-tokens of any slice, in the printable characters of their bytes."""
        return [word for word, _ in self.split(self.normal(piece))]

    def unspelled(self, word: str) -> bytes:
        return word.translate(self.bytes).encode("latin-1")


class Memo(dict):
    """Results of ``make`` by key; two generations of ``MEMO_ENTRIES``, so that what is in use stays."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Whole texts to little-endian 32-bit ids; results for short pre-tokens come from a memo."""

    def __init__(self, merges: Merges, text: Text):
        self.merges, self.text = merges, text
        self.memo = Memo(lambda word: self.stream([word.encode()]))
        self.memo_spelled = Memo(lambda word: self.stream([text.unspelled(word)]))
        names = sorted(merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def stream(self, pieces: Iterable[bytes]) -> bytes:
        """The ids of one pre-token that comes in pieces."""
        held, out = Transducer(self.merges), array.array("I")
        for data in pieces:
            out.extend(held.feed(data))
        out.extend(held.finish())
        return _packed(out)

    def slices(self, text: str) -> Iterator[str]:
        """The text cut before white space, which neither normal forms nor pre-tokens reach across."""
        at = 0
        while len(text) - at > SLICE_CHARS and (cut := _SPACE.search(text, at + SLICE_CHARS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """The ids, four bytes each."""
        out, ids_of = [], self.memo.__getitem__
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(_packed([self.merges.special[part]]))
                continue
            for piece in self.slices(part):
                words = self.text.words(piece)
                out.append(b"".join(map(ids_of, words) if words is not None else map(self.memo_spelled.__getitem__, self.text.spelled(piece))))
        return b"".join(out)


def _packed(ids: Iterable[int]) -> bytes:
    out = ids if isinstance(ids, array.array) else array.array("I", ids)
    if sys.byteorder == "big":
        out = array.array("I", out)
        out.byteswap()
    return out.tobytes()


class Decoder:
    """Ids to text, in as many calls as wanted.

    ``spelling="vocabulary"`` gives tokens as the vocabulary spells them with a space between, as a tokenizer
    file without a decoder asks for; ``"bytes"`` gives the bytes they stand for, a word end becoming a space.
    Unknown ids give nothing.
    """

    def __init__(self, merges: Merges, spelling: str = "vocabulary"):
        self.table, self.joint = _spelled(merges, spelling)
        self.reset()

    def reset(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: bytes) -> str:
        """Packed ids in, the text that is complete out."""
        view = array.array("I", ids)
        if sys.byteorder == "big":
            view.byteswap()
        pieces = [p for p in map(self.table.get, view) if p is not None]
        if not pieces:
            return ""
        data = self.joint.join(pieces)
        if self.begun and self.joint:
            data = self.joint + data
        self.begun = True
        return self.state.decode(data)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.reset()
        return out

    def decode(self, ids: bytes, step: int = 1 << 18) -> str:
        if len(ids) <= step:
            return self.feed(ids) + self.finish()
        return "".join([*(self.feed(ids[i : i + step]) for i in range(0, len(ids), step)), self.finish()])


def _spelled(merges: Merges, spelling: str) -> tuple[dict[int, bytes], bytes]:
    names = merges.vocab | merges.special
    if spelling == "vocabulary":
        return {i: t.encode() for t, i in names.items()}, b" "
    if spelling != "bytes":
        raise ValueError(f"unknown spelling {spelling!r}")
    back = {c: b for b, c in enumerate(byte_letters())}
    out = {i: t.encode() for t, i in merges.special.items()}
    for t, i in merges.vocab.items():
        end = bool(merges.end) and t.endswith(merges.end)
        body = t[: len(t) - len(merges.end)] if end else t
        if all(c in back for c in body):
            out.setdefault(i, bytes(back[c] for c in body) + b" " * end)
    return out, b""


@functools.cache
def merges(path: str) -> Merges:
    return Merges.load(path)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that the memo lasts over batches and tasks."""
    return Encoder(merges(path), Text(path))


@functools.cache
def decoder(path: str, spelling: str) -> Decoder:
    return Decoder(merges(path), spelling)


shared.REMEMBERED["bpe"] = encoder.cache_clear


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(text: str | Column, path: str | None = None) -> Column:
    """Column of packed little-endian unsigned 32-bit ids (binary); null stays null.

    ``path``: a byte-level BPE tokenizer file that every executor has.
    """
    path = path or public_vocabulary()

    @F.arrow_udf("binary")
    def ids(texts):
        import pyarrow as pa

        e = encoder(path)
        return pa.array([None if t is None else e.encode(t) for t in texts.to_pylist()], pa.binary())

    return ids(text)


def decode(ids: str | Column, path: str | None = None, spelling: str = "vocabulary") -> Column:
    """Column of text from packed ids; null stays null."""
    path = path or public_vocabulary()

    @F.arrow_udf("string")
    def text(packed):
        import pyarrow as pa

        d = decoder(path, spelling)
        return pa.array([None if x is None else d.decode(x) for x in packed.to_pylist()], pa.string())

    return text(ids)


def round_trip(text: str | Column, path: str | None = None, spelling: str = "vocabulary") -> Column:
    """Column of structs: packed ``ids`` and the text ``decoded`` from them, each text being encoded once.

    Spark runs a chain of Python functions in one step and would encode again for the second.
    """
    path = path or public_vocabulary()

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(texts):
        import pyarrow as pa

        e, d = encoder(path), decoder(path, spelling)
        ids = [None if t is None else e.encode(t) for t in texts.to_pylist()]
        decoded = [None if x is None else d.decode(x) for x in ids]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return both(text)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with the columns ``ids`` (packed) and ``n_tokens``; no shuffle. Clashing names get a leading "_"."""
    shared.session(docs)
    ids, n = shared.fresh(docs, "ids"), shared.fresh(docs, "n_tokens")
    return docs.withColumn(ids, encode(F.col(text), path)).withColumn(n, (F.octet_length(ids) / 4).cast("long"))
