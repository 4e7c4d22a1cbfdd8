import hashlib
import random
import re
import time
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slackline.llm import exact_dedup, near_dedup, simhash, suffix_dedup


def test_trie_spills_by_subtree_and_loses_nothing():
    rnd = random.Random(1)
    keys = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    trie = exact_dedup.Trie(lambda a, b: a + b, budget=20_000)
    for k in keys:
        trie.add(k, 1)
    assert trie.spilled
    want = defaultdict(int)
    for k in keys:
        want[k] += 1
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("budget", [5_000, 1 << 20])
def test_every_value_settles_once_with_its_terminal(budget):
    rnd, told = random.Random(2), []
    keys = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 6))) for _ in range(3000)]
    trie = exact_dedup.Trie(lambda a, b: a, budget, lambda new, held: told.append((new, held)))
    for i, k in enumerate(keys):
        trie.add(k, i)
    assert bool(trie.spilled) == (budget == 5_000)
    named = dict(trie.items())
    assert sorted(new for new, _ in told) == list(range(3000))
    assert all(named[keys[new]] == held and keys[held] == keys[new] for new, held in told)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_classes(docs, odd, keep):
    got = exact_dedup.classes(docs(odd), keep=keep, trie_bytes=4096).collect()
    groups = defaultdict(list)
    for i, t in odd:
        groups[t or ""].append(i)
    assert len(got) == len(odd)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = [i for i in by[r["text_sha256"]] if i is not None]
        assert r["group_size"] == len(by[r["text_sha256"]])
        assert r["keep_id"] == ((max if keep == "largest" else min)(ids) if ids else None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_deduplicate_keeps_one_row_and_all_columns(docs, odd):
    d = docs(odd)
    out = exact_dedup.deduplicate(d, keep="largest")
    assert out.columns == d.columns
    assert sorted((r["text"] or "") for r in out.collect()) == sorted({t or "" for _, t in odd})
    assert exact_dedup.deduplicate(docs([])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.classes(d, keep="any")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    forest = simhash.Forest()
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                forest.join(a, b)
    return forest


def near(rnd, n):
    out = set()
    for _ in range(n):
        x = base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            out.add(x)
            x = base if rnd.random() < 0.5 else x
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
    return sorted(out | {0, 1, (1 << 64) - 1})


def test_bit_sliced_comparison_matches_brute_force():
    values = near(random.Random(4), 60)
    u = np.array(values, np.uint64)
    want = brute_components(values)
    for parts in (1, 3):
        forest, tiles = simhash.Forest(), np.array_split(u, parts)
        for i, a in enumerate(tiles):
            for b in tiles[i:]:
                simhash.link_bucket(a, b, forest)
        assert all(forest.find(v) == want.find(v) for v in values)


@pytest.mark.parametrize("words, radius", [(1, 3), (1, 0), (2, 9), (4, 80)])
def test_bit_sliced_distances_of_any_width_and_radius(words, radius):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 1 << 63, (20, words), np.uint64)
    values = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, (20, words), np.uint64)) * rng.integers(0, 2, (20, words)).astype(np.uint64) for _ in range(9))])
    for _ in range(radius // 2):
        values[rng.integers(0, 200, 60), rng.integers(0, words, 60)] ^= np.uint64(1) << rng.integers(0, 64, 60, np.uint64)
    bits = np.unpackbits(values.view(np.uint8).reshape(200, -1), axis=1)
    far = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    i, j = simhash.Sliced(values, radius).near(values)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(list, np.nonzero(far <= radius)))) and (far > radius).any()


def test_wide_fingerprints_keep_what_is_similar_near():
    rng = np.random.default_rng(2)
    for n in (4, 9, 40, 400):
        far = []
        for _ in range(300):
            common = rng.integers(0, 1 << 63, n, np.uint64)
            m = max(1, round(n * 0.25)) if n == 4 else round(n / 8)
            a = np.concatenate([common, rng.integers(0, 1 << 63, m if n > 4 else 0, np.uint64)])
            b = np.concatenate([common, rng.integers(0, 1 << 63, m, np.uint64)])  # a similarity of 0.8
            x = simhash.wide(a, near_dedup.WORDS) ^ simhash.wide(b, near_dedup.WORDS)
            far.append(sum(int(v).bit_count() for v in x))
        assert max(far) <= near_dedup.RADIUS - 5


@pytest.mark.parametrize("tile", [4096, 3])
def test_links_and_components_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    values = near(random.Random(tile), 25)
    signed = {v - (v >> 63 << 64): v for v in values}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    forest = simhash.Forest()
    for r in edges.collect():
        assert r["a"] != r["b"]
        forest.join(signed[r["a"]], signed[r["b"]])
    want = brute_components(values)
    assert all(forest.find(v) == want.find(v) for v in values)
    found = {r["vertex"]: r["component"] for r in simhash.components(edges).collect()}
    for a in found:
        for b in found:
            assert (found[a] == found[b]) == (want.find(signed[a]) == want.find(signed[b]))


def test_components_of_a_long_chain(spark):
    chain = [(i + 1, i) for i in range(300)]
    found = simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(found) == 301 and {r["component"] for r in found} == {0}


def test_near_duplicates(docs, odd):
    words = [f"w{i}" for i in range(400)]
    rows = [*odd, (20, " ".join(words)), (21, " ".join([*words, "end"])), (19, " ".join(words).upper())]
    out = simhash.near_duplicates(docs(rows)).collect()
    prints = {}
    for i, t in rows:
        prints.setdefault(i, brute_fingerprint(t))
    want = brute_components(sorted(set(prints.values())))
    roots = defaultdict(list)
    for i, f in prints.items():
        roots[want.find(f)].append(i)
    assert len(out) == len(rows)
    for r in out:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
        ids = [i for i in roots[want.find(prints[r["doc_id"]])] if i is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    d = docs(rows)
    left = simhash.deduplicate(d)
    assert left.columns == d.columns and left.count() == len(roots)
    assert simhash.deduplicate(docs([])).count() == 0


def brute_repeats(rows):
    """By id: n_bytes, n_removed, n_spans and the bytes that stay."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeats_match_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 50)
    rnd = random.Random(hot)
    word = lambda: "".join(rnd.choice(("an", "er", "lo", "é")) for _ in range(rnd.randint(1, 3)))
    passages = [" ".join(word() for _ in range(rnd.randint(8, 40))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "a" * 500), (4, "b" + "a" * 120 + "c"), (5, "ab" * 90), (6, "\0" * 80), (7, "z" + "\0" * 90)]
    for i in range(8, 60):
        rows.append((i, " ".join(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(word() for _ in range(12)) for _ in range(rnd.randint(1, 4)))))
    rows += [(100, rows[20][1]), (101, rows[20][1])]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs(rows)).collect())
    assert [(*r[:4], bytes(r[4])) for r in got] == brute_repeats(rows)


def test_repeats_of_a_whole_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert [(*r[:4], bytes(r[4])) for r in got] == brute_repeats(rows)


def test_repeats_of_odd_rows(docs, odd):
    got = suffix_dedup.remove_repeats(docs(odd))
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[7]["n_removed"] == by[8]["n_removed"] == 0 and by[None]["n_removed"] == 0 and by[0]["n_bytes"] == 0
    assert got.count() == len(odd)
    assert suffix_dedup.remove_repeats(docs([])).count() == 0
    same = suffix_dedup.remove_repeats(docs([(1, "q" * 60), (1, "q" * 60), (None, "q" * 60)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in same) == [(-1, 60), (1, 0), (1, 0)]


@pytest.mark.parametrize("hot", [1000, 1])
def test_marks_return_to_rows_of_a_repeated_id(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(6)
    make = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(120))
    passage, own, twin = make(), [make() for _ in range(4)], make()
    rows = [(1, passage), (None, own[0] + passage), (None, own[1] + twin), (7, own[2] + passage + twin), (7, own[3] + twin)]
    got = sorted(bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(docs(rows)).collect())
    assert got == sorted([passage, own[0], own[1], own[2] + twin, own[3] + twin])


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_repeats_by_ids_of_any_type(spark, kind):
    passage, other = "a passage that several of the documents share, word by word. ", "another one, which only those without an id have in common. "
    ids = {"long": [-(1 << 63), 3, (1 << 63) - 1], "string": ["", "10", "9"], "date": [date(1, 1, 1), date(1999, 1, 1), date(2000, 1, 1)]}[kind]
    rows = [(ids[2], "last " + passage), (None, "none " + passage), (None, "two " + passage + other), (None, other + "three"), (ids[0], "first " + passage), (ids[1], "middle")]
    rows += [(None, f"no id, number {i}: " + passage) for i in range(40)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, f"doc_id {kind}, text string"))
    assert found.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    place = lambda i: (i is None, i if i is not None else ids[0])
    want = brute_repeats([(place(i), t) for i, t in rows])
    assert sorted((place(r["doc_id"]), *r[1:4], bytes(r["kept"])) for r in found.collect()) == want
    assert sum(r[2] > 0 for r in want) == 43  # all with the passage but the first; texts without an id remove nothing from each other


def test_texts_of_one_id_are_spread_over_chunks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1000)
    rnd, seen = random.Random(3), []
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(60)]
    write = suffix_dedup.shared.table
    monkeypatch.setattr(suffix_dedup.shared, "table", lambda df, name, *a: seen.append((name, write(df, name, *a))) or seen[-1][1])
    rows = [(None, t) for t in texts] + [(1, t[:90]) for t in texts]
    got = {bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs(rows)).collect()}
    assert got == {t[90:].encode() for t in texts} | {t[:90].encode() for t in texts}
    marks = next(t for name, t in seen if name == "repeats-marks")
    assert marks.select("doc").distinct().count() == 1 and marks.select("chunk").distinct().count() > 10


def test_strings_that_fill_no_half_of_a_window_send_no_segments(docs, monkeypatch):
    """By its anchor's 16 bytes alone every text had segments here, and what was sent grew faster than the table."""
    rnd, seen = random.Random(4), {}
    write = suffix_dedup.shared.table
    monkeypatch.setattr(suffix_dedup.shared, "table", lambda df, name, *a: seen.setdefault(name, write(df, name, *a)))
    some = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(100))
    passage = some()
    rows = [some() + "words that recur in all" + some() for _ in range(300)]
    assert {r["n_removed"] for r in suffix_dedup.remove_repeats(docs(rows)).collect()} == {0} and seen["repeats-anchors"].isEmpty()
    seen.clear()
    got = suffix_dedup.remove_repeats(docs([*rows, some() + passage, passage + some()])).collect()
    assert sorted(r["n_removed"] for r in got)[-2:] == [0, 100] and not seen["repeats-anchors"].isEmpty()


def test_pieces_of_a_long_text_meet(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choice(b"ab ") for _ in range(3000)), np.uint8)
    whole = [tuple(x.tolist() for x in r) for r in suffix_dedup.runs(data)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    windows = {}
    for key, start, n, place in suffix_dedup.runs(data):
        for k, s, w, p in zip(key.tolist(), start.tolist(), n.tolist(), place.tolist()):
            windows |= {s + i: (k, s + p) for i in range(w)}
    want = {s + i: (k, s + p) for k, s, n, p in zip(*whole[0]) for i in range(n)}
    assert windows == want and len(want) == 3000 - 49


def test_equal_texts_keep_the_smallest_whatever_the_partition(docs):
    rows = [(i, "same text here") for i in range(50)]
    got = exact_dedup.classes(docs(rows).repartition(7), keep="smallest").agg(F.count_if("kept"), F.max("keep_id"), F.min("group_size")).first()
    assert tuple(got) == (1, 0, 50)


def brute_jaccard(a, b):
    sets = []
    for t in (a, b):
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("tile", [1 << 20, 2000])
def test_near_copies_of_similarity_080_to_095_go_and_others_stay(docs, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rnd = random.Random(5)
    rows, want, seen = [], set(), []
    for k in range(120):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 300))]
        copy = list(words)
        for at in rnd.sample(range(len(words)), rnd.randint(1, 5)):
            copy[at] = f"v{rnd.randrange(10**6)}"
        j = brute_jaccard(" ".join(words), " ".join(copy))
        rows += [(2 * k + 1, " ".join(words)), (2 * k + 2, " ".join(copy).upper())]
        want |= {2 * k + 1} | ({2 * k + 2} if j < 0.8 else set())
        seen.append(j)
    assert sum(0.8 <= j <= 0.95 for j in seen) > 30 and sum(0.6 <= j < 0.8 for j in seen) > 10
    # a large group: each differs from the first in its last words
    base = [f"b{i}" for i in range(200)]
    rows += [(1000 + i, " ".join([*base, *(f"e{i}x{j}" for j in range(5))])) for i in range(60)]
    want.add(1000)
    got = simhash.deduplicate(docs(rows), words=5, least=0.8)
    assert {r["doc_id"] for r in got.collect()} == want
    lost = [b for (a, x), (b, y) in zip(rows[:240:2], rows[1:240:2]) if (brute_fingerprint(x) ^ brute_fingerprint(y)).bit_count() > 3 and b not in want]
    assert len(lost) > 20  # copies that three bits of three-word shingles leave


def test_near_dedup_of_odd_rows(docs, odd):
    d = docs(odd)
    out = near_dedup.deduplicate(d)
    assert out.columns == d.columns and near_dedup.deduplicate(docs([])).count() == 0
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect()) == [-1, 0, 4, 6, 7, 8, 9]
    edge = [(3, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l x")]  # 8 of 10 shingles
    assert [r["doc_id"] for r in near_dedup.deduplicate(docs(edge)).collect()] == [2]
    assert near_dedup.deduplicate(docs([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k x")])).count() == 2  # 7 of 9


def test_an_owner_is_linear_in_a_class_s_representatives():
    """A class has one representative for each input partition; 100 000 of them cost about a hundred times 1 000."""
    import pyarrow as pa

    own, _ = exact_dedup._own("bigint", True, exact_dedup.TRIE_BYTES)
    n = 100_000
    batch = pa.RecordBatch.from_arrays([pa.array([3] * n), pa.array(range(n), pa.int64()), pa.array(range(n)), pa.array(range(n)), pa.array([b""] * n, pa.binary()), pa.array([2] * n)], ["bucket", "id", "row", "rep", "text", "n"])
    began = time.perf_counter()
    rows = [r for b in own(iter([batch])) for r in b.to_pylist()]
    assert time.perf_counter() - began < 5
    assert {r["rep"] for r in rows} == set(range(n)) and {(r["keep_id"], r["group_size"]) for r in rows} == {(n - 1, 2 * n)}
