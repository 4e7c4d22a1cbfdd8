import array
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slackline.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_vocabulary())


def ids_of(packed):
    return list(array.array("I", packed))


ODD = ["", "  ", "Σας ΟΔΟΣ Σ", "it's we'll 'S \"'s", "<|endoftext|>a<|startoftext|><|endoftext|x", "a" * 5000, "ab" * 3000 + "!?" * 2000, "\x1c\x1f\x85\xa0x", "漢字かな", "😀😀👍🏽 𝒳 ½ ²Ⅷ", "İstanbul DŽ ŉ", "‍​﻿x", "é̩ ́ a", "ﬁ Å", "١٢٣", "\x00a", "a_b", "ing" * 3000 + "é" * 999]


def test_encoding_and_decoding_match_the_library(library):
    rnd = random.Random(1)
    parts = [t.replace("</w>", "") for t in list(library.get_vocab())[:4000]]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 300))) for _ in range(100)]
    e, d = bpe.encoder(bpe.public_vocabulary()), bpe.Decoder(bpe.merges(bpe.public_vocabulary()))
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(e.encode(t)) == want, t[:50]
        assert d.decode(e.encode(t)) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_is_split_as_the_library_does(library):
    e = bpe.encoder(bpe.public_vocabulary())
    for mark in ("", "\u0301"):
        for at in range(0, 0x110000, 256):
            texts = [f"a{chr(c)}{mark}1" for c in range(at, at + 256) if not 0xD800 <= c < 0xE000]
            if not texts:
                continue
            whole = " ".join(texts)
            if ids_of(e.encode(whole)) != library.encode(whole, add_special_tokens=False).ids:
                assert [t for t in texts if ids_of(e.encode(t)) != library.encode(t, add_special_tokens=False).ids] == [], hex(at)
                raise AssertionError(f"differs at {at:x} in the whole only")


def test_every_pre_token_of_documents_goes_through_the_transducer(library, monkeypatch):
    import duckdb

    seen, fed = [0], bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, data: (seen.__setitem__(0, seen[0] + 1), fed(self, data))[1])
    e, words = bpe.Encoder(bpe.merges(bpe.public_vocabulary()), bpe.Text(bpe.public_vocabulary())), set()
    for (t,) in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(e.encode(t)) == want
        words.update(e.text.words(t) or ())
    assert seen[0] >= len(words) > 1000


def test_a_pre_token_in_pieces(library):
    e = bpe.encoder(bpe.public_vocabulary())
    data = ("anst" * 2000).encode()
    assert ids_of(e.stream(data[i : i + 7] for i in range(0, len(data), 7))) == library.encode(data.decode(), add_special_tokens=False).ids


def test_streamed_tokens_are_those_of_the_whole():
    m = bpe.merges(bpe.public_vocabulary())
    rnd = random.Random(2)
    data = "".join(rnd.choice(("the", "in", "ing", "an", "er", "x", "sti", "ou")) for _ in range(3000)).encode()
    stream, got = bpe.Transducer(m), []
    for at in range(0, len(data), 97):
        got += stream.feed(data[at : at + 97])
        assert len(stream.held) <= stream.window + 97
    got += stream.finish()
    assert got == m.merge([m.start[b] for b in data[:-1]] + [m.last[data[-1]]])


def small():
    letters = bpe.byte_letters()
    merges = [("a", "b"), ("ab", "c"), ("c", "a"), ("ab", "ab"), ("d", "abab")]
    names = letters + [a + b for a, b in merges]
    return bpe.Merges({t: i for i, t in enumerate(names)}, merges)


def test_lookahead_bounds_every_change():
    m, rnd = small(), random.Random(3)
    assert 0 < m.lookahead < 20
    for _ in range(3000):
        x = "".join(rnd.choice("abcd") for _ in range(30))
        seen = []
        for tail in ("", "".join(rnd.choice("abcd") for _ in range(10))):
            ends, at = [], 0
            for t in m.merge([m.start[b] for b in (x + tail).encode()]):
                at += m.symbols[t]
                ends.append(at)
            seen.append([e for e in ends if e <= len(x) - m.lookahead])
        assert seen[0] == seen[1]


def test_an_improper_merge_list_is_refused():
    with pytest.raises(ValueError):
        bpe.Merges({c: i for i, c in enumerate([*bpe.byte_letters(), "ab", "abc"])}, [("ab", "c"), ("a", "b")])


def test_bytes_spelling_round_trips_across_cut_characters():
    m = small()
    d = bpe.Decoder(m, "bytes")
    packed = bpe._packed(m.merge([m.start[b] for b in "é漢ab".encode()]))
    assert "".join([*(d.feed(packed[i : i + 4]) for i in range(0, len(packed), 4)), d.finish()]) == "é漢ab"
    with pytest.raises(ValueError):
        bpe.Decoder(m, "other")


def test_columns(docs, odd, library):
    out = bpe.encode_documents(docs(odd))
    assert {"_ids", "n_tokens", "ids"} <= set(out.columns)
    for r in out.withColumn("back", bpe.decode("_ids")).collect():
        if r["text"] is None:
            assert r["_ids"] is None and r["back"] is None
        else:
            want = library.encode(r["text"], add_special_tokens=False).ids
            assert ids_of(r["_ids"]) == want and r["n_tokens"] == len(want) and r["back"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs([])).count() == 0
    both = docs(odd).where("text is not null").select("text", bpe.round_trip(F.col("text")).alias("c"))
    assert all(ids_of(r["c"]["ids"]) == library.encode(r["text"], add_special_tokens=False).ids for r in both.collect())


def test_packing_covers_every_token_once(docs, odd, library):
    window = 64
    rows = packing.pack(docs(odd), window=window).collect()
    tokens = {}
    for i, t in odd:
        tokens.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    whole, sequences = {}, {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) // 4 > 0
    assert whole.keys() == tokens.keys()
    for i, found in whole.items():
        if len(tokens[i]) == 1:
            found.sort(key=lambda r: r["start"])
            assert [x for r in found for x in ids_of(r["ids"])] == tokens[i][0]
            assert [r["start"] for r in found] == [sum(p["length"] for p in found[:k]) for k in range(len(found))]
    lengths = []
    for k in range(len(sequences)):
        at = 0
        for offset, n in sorted(sequences[k]):
            assert offset == at
            at += n
        lengths.append(at)
    assert set(lengths[:-1]) <= {window} and lengths[-1] <= window
    assert sum(lengths) == sum(len(t) for ts in tokens.values() for t in ts)
    assert packing.pack(docs([])).count() == 0
