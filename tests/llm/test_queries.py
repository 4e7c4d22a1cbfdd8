"""The registered queries and the pipeline on whole small tables."""

import hashlib
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from oracle import assert_same, connect

import __spark_entry__ as entry
import corpus_pipeline
from slackline.llm import bpe, pii, queries, quality, shared, simhash, syncmers

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    """Of the distinct five-word shingles."""
    sets = []
    for words in (a.lower().split(), b.lower().split()):
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_row_for_each_document(spark, name):
    out = queries.QUERIES[name](spark, SF)
    want = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    got = out.select("doc_id").distinct().count()
    assert got == want and (name in ("op10_pack", "op11_best_two_fit") or out.count() == want)
    assert entry.queries()[name] is queries.QUERIES[name]


def test_pipeline_stages_match_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.table(stage(spark, at, SF), "test")
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        before = {r["doc_id"]: r for r in at.collect()}
        assert rows and rows.keys() <= before.keys(), name
        kept.append((name, before, rows))
        at = out
    _, before, rows = kept[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in rows for i, q in labels.items() if q) and rows.keys() < before.keys()
    _, before, rows = kept[1]
    last = {}
    for i, r in before.items():
        last[r["text"]] = max(i, last.get(r["text"], i))
    assert rows.keys() == set(last.values())
    _, before, rows = kept[2]
    texts = {i: r["text"] or "" for i, r in before.items()}
    forest = simhash.Forest()
    for a, b in combinations(sorted(texts), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            forest.join(a, b)
    assert rows.keys() == {forest.find(i) for i in texts} < texts.keys()
    _, before, rows = kept[3]
    model = pii.fit(shared.documents(spark, SF).join(spark.createDataFrame([(i,) for i in before], "doc_id long"), "doc_id", "left_semi"))
    assert all(r["text"] == pii.redacted(before[i]["text"], pii.find(before[i]["text"], model)[1]) and r["n_chars"] == len(r["text"]) for i, r in rows.items())
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == rows.keys()


def library_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_vocabulary())
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    return library, texts, {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_tokens_and_texts_are_the_library_s(spark):
    library, _, ids = library_ids()
    for r in queries.op1_bpe(spark, SF).collect():
        want = ids[r["doc_id"]]
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_pieces_are_cut_out_of_the_library_s_tokens(spark):
    _, _, ids = library_ids()
    rows, held, ends = queries.op10_pack(spark, SF).collect(), {}, {}
    for r in rows:
        want = [*ids[r["doc_id"]], 1]
        piece = np.array(want[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(want) and len(piece) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(piece.tobytes())
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces, whole in [*((held[i], len(ids[i]) + 1) for i in ids), *((ends[k], None) for k in ends)]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == whole if whole is not None else at <= 2048
    short = [k for k in ends if sum(n for _, n in ends[k]) < 2048]
    assert sorted(ends) == list(range(len(ends))) and short in ([], [max(ends)])


def test_shards_hold_nearly_equal_bytes(spark):
    _, texts, _ = library_ids()
    rows, load = queries.op2_shard(spark, SF).collect(), [0] * 16
    of_text = {}
    assert all(of_text.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"] for r in rows) and len(of_text) < len(rows)  # equal texts stay together
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
    assert max(load) - min(load) <= 0.02 * sum(load) / 16 + max(r["size"] for r in rows)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_fingerprints_of_edited_texts(spark):
    _, texts, _ = library_ids()
    order = sorted(texts)
    for r in queries.op7_syncmers(spark, SF).collect():
        t, following = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        own, other, after = (set(syncmers.anchors(syncmers._code_points(x))[0].tolist()) for x in (t, changed, following))
        own, other, after = ({h >> 32 for h in x} for x in (own, other, after))
        alike = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == alike(own, other) and r["near_next"] == alike(own, after)
        smallest = sorted(other)[: max(syncmers.SKETCH, len(other) // syncmers.SHARE)]
        assert r["edited_fingerprint"] == "".join(f"{h:08x}" for h in smallest)


def test_only_the_entry_point_tolerates_missing_modules():
    assert entry.corpus_pipeline is corpus_pipeline and quality.SAMPLE_ROWS > 0
