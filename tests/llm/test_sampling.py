"""Best-two-fit packing, periodic runs and importance resampling against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from slackline.llm import best_fit, bpe, importance, queries, runs

SF = "/root/testdata/sf0.001"


def texts_of(table="documents", column="doc_id"):
    return {i: t or "" for i, t in duckdb.sql(f"SELECT {column}, text FROM '{SF}/{table}.parquet'").fetchall()}


# --- best-two-fit ---------------------------------------------------------------------------------------------------


def windows_one_by_one(lengths, window):
    """Best-two-fit as it is told: a window at a time, pieces one by one."""
    left, out = Counter(lengths), []
    while left:
        gap, held = window, []
        while fit := [n for n in left if n <= gap]:
            held.append(max(fit))
            left[max(fit)] -= 1
            left, gap = +left, gap - max(fit)
        if len(held) > 1:
            least = min(held)
            pairs = [(a + b, a, b) for a in left for b in left if b <= a and (b < a or left[a] > 1) and least < a + b <= gap + least]
            if pairs:
                _, a, b = max(pairs)
                held.remove(least)
                held += [a, b]
                left.update([least])
                left.subtract([a, b])
                left = +left
        out.append(tuple(sorted(held)))
    return Counter(out)


@pytest.mark.parametrize("seed", range(40))
def test_the_plan_repeats_fillings_exactly(seed):
    rnd = random.Random(seed)
    window = rnd.choice([5, 10, 50, 100])
    lengths = [rnd.randint(1, window) for _ in range(rnd.randint(0, 80))] + [rnd.randint(1, window)] * rnd.choice([0, 0, 60])
    plan, got = best_fit.plan(Counter(lengths), window), Counter()
    for filling, times in plan:
        got[tuple(sorted(Counter(filling).elements()))] += times
    assert got == windows_one_by_one(lengths, window)
    table, at = best_fit.places(plan), {}
    for n, c in Counter(lengths).items():
        for s, o in zip(*best_fit.placed(table, np.full(c, n), np.arange(c))):
            at.setdefault(int(s), []).append((int(o), n))
    assert sorted(at) == list(range(got.total()))
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= window


def test_a_plan_s_size_does_not_grow_with_the_corpus():
    rnd = random.Random(1)
    plan = best_fit.plan({n: rnd.randint(1, 10**9) for n in range(1, 2049)})
    assert len(plan) < 2048 * (1 + math.log(2048))


def check_pieces(rows, ids, window, stop, crc=True):
    held, at = {}, {}
    for r in rows:
        want = [*ids[r["doc_id"]], stop]
        piece = np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(piece) if crc else bytes(r["ids"]) == piece
        held.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert held.keys() == ids.keys()
    for i, pieces in held.items():
        n = len(ids[i]) + 1
        first = (n - 1) % window + 1
        assert sorted(pieces) == [(k, 0 if not k else first + (k - 1) * window, first if not k else window) for k in range((n - first) // window + 1)]
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= window
    return len(at), sum(len(x) + 1 for x in ids.values())


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_vocabulary("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packed_windows_hold_the_library_s_tokens(spark):
    encode = library()
    ids = {i: encode(t) for i, t in texts_of().items()}
    n, tokens = check_pieces(queries.op11_best_two_fit(spark, SF).collect(), ids, 2048, 0)
    assert tokens / 2048 <= n <= 1.02 * tokens / 2048 + 1


def test_packing_odd_rows(spark, docs, odd):
    encode = library()
    rows = [(k, t) for k, (_, t) in enumerate(odd)]
    ids = {i: encode(t or "") for i, t in rows}
    check_pieces(best_fit.pack(docs(rows), window=64).collect(), ids, 64, 0, crc=False)
    repeated = best_fit.pack(docs(odd), window=64)
    assert repeated.count() == sum(-(-(len(encode(t or "")) + 1) // 64) for _, t in odd)
    assert best_fit.pack(docs([])).count() == 0


def test_byte_level_tokens_of_any_text():
    e, encode = best_fit.encoder(bpe.public_vocabulary("byte_bpe_50k.json")), library()
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 4000):
        text = "".join(f"a{c}a {c} 1{c}1!{c}! {c}" for c in points[at : at + 4000])
        assert e.encode(text).tolist() == encode(text)
    for text in ("", " ", "a<|endoftext|>b  <|endoftext|>", "it's I'LL  x\n\n y ", "\t" * 3000 + "x", "word " * 300_000 + "a b"):
        assert e.encode(text).tolist() == encode(text)
    assert e.encode(" " * 1_500_000 + "x").tolist() == encode(" " * 1_500_000 + "x")  # more than tiktoken's expressions take


# --- periodic runs --------------------------------------------------------------------------------------------------


def runs_by_scan(w, least=6, repeats=4):
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, repeats * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_words(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(rnd.randint(0, 7)):
        w = [rnd.choice("abcdefghijklmnopqrst"[: rnd.choice([1, 2, 3, 20])]) for _ in range(rnd.choice([0, 1, 5, 6, 8, 30, 200]))]
        for _ in range(rnd.randint(0, 3)):
            p, at = rnd.randint(1, 12), rnd.randint(0, len(w))
            s = [rnd.choice("abcxyz") for _ in range(p)]
            w[at:at] = [s[i % p] for i in range(rnd.randint(1, 5) * p + rnd.randint(0, p))]
        texts.append(w)
    for least, repeats in ((6, 4), (2, 2), (9, 3)):
        got = runs._batch([" ".join(w).encode() for w in texts], least, repeats)
        for w, (found, rest) in zip(texts, got):
            want = runs_by_scan(w, least, repeats)
            assert [(s, e - s, q) for s, e, q in found.tolist()] == want and rest.decode() == collapsed(w, want)


def test_a_long_text_of_one_word_is_one_run():
    (found, rest), (other, _) = runs._batch([b"a " * 300_000, b"x y " * 50_000], 6, 4)
    assert found.tolist() == [[0, 300_000, 1]] and rest == b"a" and other.tolist() == [[0, 100_000, 2]]


def test_runs_of_all_documents(spark):
    texts = texts_of()
    rows = queries.op12_runs(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and any(r["n_runs"] for r in rows)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = runs_by_scan(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None, None, None)
        assert r["n_runs"] == len(found) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()


def test_runs_of_odd_rows(spark, docs, odd):
    rows = [(k, t) for k, (_, t) in enumerate([*odd, (0, "a b a b a b a b c"), (0, "a\xa0b " * 8 + "\x1f")])]
    out = {r["doc_id"]: r["periodic"] for r in runs.detect(docs(rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = runs_by_scan(w) if len(w) < 1000 else [(0, 20_000, 1)]
        assert [tuple(x) for x in out[i]["runs"]] == found and out[i]["collapsed"] == collapsed(w, found)
    assert runs.detect(docs([])).count() == 0
    assert "_periodic" in runs.detect(docs(rows).withColumnRenamed("pii", "Periodic")).columns


# --- importance resampling ------------------------------------------------------------------------------------------


def resampled(docs, target, n=2, buckets=10_000, percent=25, least=20, seed=7):
    """Rows of (id, text), one by one: id, n_features, weight, score, rank."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    here, there = Counter(b for _, t in docs for b in grams(split(t))), Counter(b for t in target for b in grams(split(t)))
    all_here, all_there = here.total(), there.total()
    gain = lambda b: math.floor(1000 * math.log((there[b] + 1) * (all_here + buckets) / ((here[b] + 1) * (all_there + buckets))))
    out = []
    for i, t in docs:
        w = split(t)
        found = grams(w)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    large = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {r[0]: k + 1 for k, r in enumerate(large[: percent * len(large) // 100])}
    return sorted(((*r[:4], drawn.get(r[0])) for r in out), key=str)


def test_resampling_all_documents(spark):
    want = resampled(list(texts_of().items()), texts_of("benchmark", "item_id").values())
    assert sorted(map(tuple, queries.op13_importance(spark, SF).collect()), key=str) == want


def test_resampling_odd_rows(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK_BYTES", 2000)  # many chunks
    monkeypatch.setattr(importance, "OWNER_BYTES", 50_000)
    rows = [(None if k == 8 else k, t) for k, (_, t) in enumerate([*odd, *((0, f"Common words and number {k % 7} of {k}, été " * (k % 9)) for k in range(60))])]
    target = ["common words", None, "", "number 3 of 10, ÉTÉ"]
    names = "doc_id", "n_features", "weight", "score", "rank"
    table = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    for n, buckets in ((2, 10_000), (3, 100_000), (1, 7)):
        got = importance.resample(docs(rows), table, n=n, buckets=buckets, percent=40, least_words=5)
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == resampled(rows, target, n, buckets, 40, 5)
    none = importance.resample(docs(rows), table.limit(0))
    assert none.count() == len(rows)
    assert importance.resample(docs([]), table).count() == 0
    again = importance.resample(docs([(1, "the same words " * 10)] * 8), table, percent=50)
    assert sorted(r["rank"] or 0 for r in again.collect()) == [0, 0, 0, 0, 1, 2, 3, 4]
