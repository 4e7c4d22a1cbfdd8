import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.llm import linear, pii, quality, sharding, shared, syncmers, toxicity

SF = "/root/testdata/sf0.001"


def test_sharding(spark, docs, odd):
    rows = [*odd, *((100 + i, "t" * (i * 37 % 400)) for i in range(400))]
    out = sharding.shard(docs(rows), shards=4, slots=64).collect()
    assert len(out) == len(rows)
    size = Counter()
    places = defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    texts = dict(rows)
    for r in out:
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    few = [r for r in out if r["doc_id"] != 7 and r["doc_id"] != 8]  # but for two long texts, whose slots can't be cut
    assert sum(r["size"] for r in few) == sum(len((t or "").encode()) + 1 for i, t in rows if i not in (7, 8))
    even = [r for r in sharding.shard(docs(rows[len(odd) :]), shards=4, slots=256).collect()]
    load = [sum(r["size"] for r in even if r["shard"] == s) for s in range(4)]
    assert max(load) - min(load) <= 400 and sum(load) == sum(len(t) + 1 for _, t in rows[len(odd) :])
    assert sharding.shard(docs([])).count() == 0


def test_groups_stay_whole_but_for_those_larger_than_a_shard(docs):
    rows = [*((None, "the same text, again and again") for _ in range(800)), *((7, None) for _ in range(300)), *((i, "t" * (i * 7 % 60)) for i in range(100, 900)), *((900 + i, "u" * 50) for i in range(20))]
    out = sharding.shard(docs(rows), shards=16).collect()
    load, places, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert len(out) == len(rows) and sorted((r["doc_id"] or 0, r["size"]) for r in out) == sorted((i or 0, len(t or "") + 1) for i, t in rows)
    large = {k for k, at in groups.items() if len(at) > 1}
    assert large == {(zlib.crc32(b"the same text, again and again"), 31)} and len(groups) > 50
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 16 + max(n for n in Counter((r["text_crc32"], r["size"]) for r in out if (r["text_crc32"], r["size"]) not in large).values()) * 60
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 16


def test_shard_map_versions_move_little(spark, tmp_path):
    rnd = random.Random(1)
    records = spark.createDataFrame([(i % 256, rnd.randint(1, 1000)) for i in range(4000)], "virtual_slot int, size long")
    stats = sharding.slot_stats(records, 256)
    path = str(tmp_path / "map")
    sharding.save_map(sharding.first_map(stats, 8), path)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), 8), path)
    second = {r["slot"]: r["shard"] for r in sharding.load_map(spark, path).collect()}
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), 9), path)
    third = {r["slot"]: (r["shard"], r["bytes"]) for r in sharding.load_map(spark, path).collect()}
    assert sharding.load_map(spark, path, 1).count() == 256 and len(third) == 256
    load = Counter()
    for s, b in third.values():
        load[s] += b
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 9
    assert sum(second[k] != third[k][0] for k in second) < 256 / 3


def test_a_map_is_edited_by_the_next_table(spark, docs, tmp_path):
    path = str(tmp_path / "kept")
    tables = [[(i, "t" * (i * 37 % 400)) for i in range(n)] for n in (600, 900)]
    maps = []
    for k, rows in enumerate(tables):
        out = sharding.shard(docs(rows), shards=5, slots=128, map_path=path).collect()
        assert {r["map_version"] for r in out} == {k + 2} and len(out) == len(rows)
        load, places = Counter(), defaultdict(list)
        for r in out:
            load[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        assert max(load.values()) - min(load.values()) <= 0.1 * sum(load.values()) / 5
        maps.append({r["slot"]: r["shard"] for r in sharding.load_map(spark, path).collect()})
    assert sharding.load_map(spark, path, 1).count() == 128 == len(maps[1])
    assert sum(maps[0][s] != maps[1][s] for s in maps[0]) < 128 / 3
    with pytest.raises(ValueError):
        sharding.shard(docs(tables[0]), shards=5, slots=64, map_path=path)


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rnd = random.Random(2)
    odd = ["a@b.c@d.e", "@@a@b.cc.", "1.2.3.4.5.6.7.8", "0001.2.3.4", "256.1.1.1", "1..2.3.4.5", "+1 (499) 555-6503 +2", "4111 1111 1111 1111", "4111111111111111x", "+1+12345678"]
    for t in odd + ["".join(rnd.choice("ab1234.@+- ()") for _ in range(rnd.randint(1, 60))) for _ in range(5000)]:
        assert pii.base_spans(t) == brute_spans(t), t


def test_trees_add_spans_and_leave_others():
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t)[1]]
    for before, span, kind in [
        ("call ", "(499) 555-6503", "phone"), ("tel ", "0171 1234567", "phone"), ("phone ", "(030) 12345678", "phone"), ("call ", "5551234567", "phone"), ("mail ", "jo.doe(at)foo(dot)com", "email"),
        ("write to ", "a at b dot c dot d dot e dot f dot com", "email"), ("server ", "10[.]1[.]2[.]3", "ip"), ("card ", "4111.1111.1111.1111", "card"), ("amex ", "3782 822463 10005", "card"),
        ("token = ", "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa", "secret"),
    ]:
        assert found(f"an erlo {before}{span} senta mi") == [(kind, span)]
    for t in ("on 2020-01-02, page 12 of 30, version 2.0", "look at that dot there", "sat at home. Then left", "commit cf1d64a9a4cd9723e1f4eafc27395915e6868ffa", "nter of 7086638319846192 the anen"):
        assert found(t) == []


def test_candidates_of_documents_by_trees_fitted_on_others(spark):
    """Fitted on the documents of one table; precision and recall on shapes set into another's texts, and on its own secrets."""
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert all(h["precision"] >= 0.99 and h["recall"] > 0.9 and h["spans"] > 30 for h in model.held_out.values())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id > 1000 and length(text) > 300").select("text").collect()]
    write, right, total, there, secrets = pii.Writer(random.Random(99)), Counter(), Counter(), Counter(), [0, 0, 0]
    for i, t in enumerate(texts):
        cut = t.index(" ", 120) if " " in t[120:] else 0
        if i % 3 and cut:
            kind, lead, span = write.true() if i % 3 == 1 else (None, "", write.false())
            t = f"{t[:cut]} {lead}{span} {t[cut:]}"
            there[kind] += 1
            for k, a, b in pii.find(t, model)[1]:
                if cut < b and a < cut + len(lead + span) + 2 and t[a:b] not in ("",):
                    total[k] += 1
                    right[k] += k == kind and t[a:b].strip(" ") == span.strip(" ")
        else:
            base, every = pii.find(t, model)
            held = {m.span(1) for m in re.finditer(r"(?i)token = \"([0-9a-f]{40})\"", t)}
            added = [s for s in every if s not in base]
            secrets[0] += len(held)
            secrets[1] += sum((a, b) in held for _, a, b in added)
            secrets[2] += sum((a, b) not in held for _, a, b in added)
    assert all(right[k] >= 0.9 * there[k] > 100 for k in pii.EVERY if k != "ip") and right["ip"] >= 0.85 * there["ip"]
    assert sum(right.values()) >= 0.98 * sum(total.values())
    assert secrets[0] == secrets[1] > 20 and secrets[2] <= 3  # what documents hold beside base spans, and little else


def test_base_spans_stay_and_nothing_overlaps(spark):
    model = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base, every = pii.find(r["text"] or "", model)
        assert base == brute_spans(r["text"] or "") and [s for s in every if s in base] == base
        added = sorted((a, b) for s in every if s not in base for a, b in [s[1:]])
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))
        assert all(b <= x or y <= a for a, b in added for _, x, y in base)
    assert pii.fit(spark.createDataFrame([], "text string")).thresholds.keys() == set(pii.EVERY)


def test_many_candidates_are_swept_in_linear_steps():
    seconds = []
    for n in (2_000, 8_000):
        t = "call (499) 555-6503 now, " * n
        began = time.perf_counter()
        assert len(pii.find(t)[1]) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 10 * seconds[0]
    assert len(pii.find("at-" * 50_000 + " at " * 50_000 + "1 " * 50_000)[1]) == 0


def test_numbers_are_proposed_whatever_stands_around():
    rnd = random.Random(8)
    for t, kind, span in [
        ("12 4111 1111 1111 1111 99", "card", "4111 1111 1111 1111"), ("row 17 2024 (555) 123-4567 88 12", "phone", "(555) 123-4567"), ("see 3-4 (0555) 123 4567 5-6", "phone", "(0555) 123 4567"),
        ("1 5 5 5 1 2 3 4 5 6 7 9", "phone", "5 5 5 1 2 3 4 5 6 7"), ("06 12 34 56 78", "phone", "06 12 34 56 78"), ("00 33 6 12 34 56 78 4", "phone", "00 33 6 12 34 56 78"), ("3782 822463 10005", "card", "3782 822463 10005"),
    ]:
        assert (kind, t.index(span), t.index(span) + len(span)) in pii.proposed(t), t
    # the weak rule's recall on forms in use; only digits told one by one are lost
    forms = "(555) 123-4567|555.123.4567|5551234567|0171 1234567|06 12 34 56 78|00 33 6 12 34 56 78|0049 30 1234 5678|0 800 123 45 67|030/123 45 67|8 (495) 123-45-67|11 2345-6789|20 7946 0958"
    assert not any(map(pii.weak, forms.split("|"))) and pii.weak("5 5 5 1 2 3 4 5 6 7")
    for _ in range(300):  # all runs of groups, by hand
        groups = ["".join(rnd.choice("0123456789") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 9))]
        t = " ".join(groups)
        at = [sum(len(g) + 1 for g in groups[:i]) for i in range(len(groups))]
        runs = [(i, j, "".join(groups[i:j])) for i in range(len(groups)) for j in range(i + 1, len(groups) + 1)]
        want = {("phone", at[i], at[j - 1] + len(groups[j - 1])) for i, j, d in runs if 7 <= len(d) <= 15}
        want |= {("card", at[i], at[j - 1] + len(groups[j - 1])) for i, j, d in runs if 13 <= len(d) <= 19 and pii.luhn(d)}
        assert set(pii._numbers(t)) == want
    seconds = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        assert len(pii._numbers("1234 56 789 0 " * n)) < 19 * 4 * n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * seconds[0]


def test_redaction(docs, odd):
    d = docs([*odd, (30, "x a@b.cc y +1 (499) 555-6503")])
    out = pii.redact(d)
    assert out.columns == d.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[30] == "x [EMAIL] y [PHONE]" and got[0] is None and got[1] == "" and got[4] == "One two three four."
    assert pii.redact(docs([])).count() == 0 and pii.redacted("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a[IP]ef"
    spans = pii.detect(d).where("doc_id = 30").select("_pii.base").first()[0]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == brute_spans("x a@b.cc y +1 (499) 555-6503")


def brute_anchors(text):
    p = np.array(list(map(ord, text)), np.uint32)
    h = syncmers._grams(p, syncmers.S)
    width = syncmers.K - syncmers.S + 1
    return [i for i in range(len(text) - syncmers.K + 1) if h[i : i + width].min() in (h[i], h[i + width - 1])]


def test_syncmers_are_context_free_and_cover(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    hashes, places = syncmers.anchors(syncmers._code_points(text))
    assert places.tolist() == brute_anchors(text)
    assert np.diff(places).max() <= syncmers.K - syncmers.S + 1
    inside = syncmers.anchors(syncmers._code_points("zzz" + text[100:400] + "yyy"))
    same = dict(zip((inside[1] - 3 + 100).tolist(), inside[0].tolist()))
    assert all(same[p] == h for h, p in zip(hashes.tolist(), places.tolist()) if 100 <= p <= 400 - syncmers.K)
    monkeypatch.setattr(syncmers, "PIECE", 100)
    again = syncmers.anchors(syncmers._code_points(text))
    assert (again[0] == hashes).all() and (again[1] == places).all()


def test_likeness():
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    other = "".join(rnd.choice("ijklmnop ") for _ in range(4000))
    f = syncmers.fingerprint
    assert syncmers.likeness(f(text), f(text)) == 1 and syncmers.likeness(f(text), f(other)) < 0.05
    assert abs(syncmers.likeness(f(text), f(text[:2000] + other[:2000])) - 1 / 3) < 0.2
    assert syncmers.likeness(f(""), f("")) == 1 and syncmers.likeness(f(""), f("a")) == 0 and len(f("ab")) == 1


def common_substring(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
                best = max(best, now[j + 1])
        before = now
    return best


def test_passages_are_common_and_miss_little_of_the_longest():
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    at = lambda t: syncmers.anchors(syncmers._code_points(t))
    for n in (0, 10, 40, 60, 120):
        for _ in range(8):
            passage = make(n)
            a, b = make(rnd.randint(0, 150)) + passage + make(150), make(rnd.randint(0, 150)) + passage + make(rnd.randint(0, 90))
            found = syncmers.passages(at(a), at(b))
            assert all(a[x : x + size] == b[y : y + size] for x, y, size in found.tolist())
            most = common_substring(a, b)
            assert syncmers.longest(found) <= most and (most < 32 or syncmers.longest(found) >= most - 2 * (syncmers.K - syncmers.S))
    text = make(300)
    assert syncmers.longest(syncmers.passages(at(text * 3), at(text * 3))) >= 900 - 16
    assert syncmers.longest(syncmers.passages(at(""), at(text))) == 0


def test_each_document_meets_the_next(docs, odd):
    rows = [r for r in odd if r[0] not in (None, 5)] + [(i, f"text {i} " * i) for i in range(10, 60)]
    out = {r["doc_id"]: r for r in syncmers.compare_with_edited(docs(rows)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    repeated = [(i, t or "") for i, t in odd]
    order = lambda r: (r[0] is not None, r[0] or 0)
    got = syncmers.compare_with_edited(docs(odd)).collect()
    for i, t in repeated:  # ids that repeat or are null: each row meets one that can follow it
        later = [r for r in repeated if order(r) >= order((i, t))]
        own = [r for r in got if r["doc_id"] == i and r["n_chars"] == len(t)]
        half = len(t) // 2
        assert own and any(r["edited_text"] == t[: len(t) - half] + x[:half] for r in own for _, x in [*later, min(repeated, key=order)])
    assert len(got) == len(odd)
    assert len(out) == len(ordered)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        assert out[i]["edited_text"] == t[: len(t) - half] + following[:half] and out[i]["n_chars"] == len(t)
        assert out[i]["fingerprint"] == syncmers.spelled(syncmers.fingerprint(t))
        assert out[i]["near_next"] == syncmers.likeness(syncmers.fingerprint(t), syncmers.fingerprint(following))
    assert syncmers.compare_with_edited(docs(odd)).count() == len(odd)
    assert syncmers.compare_with_edited(docs([])).count() == 0
    assert syncmers.compare_with_edited(docs([(4, "alone in here, quite alone")])).first()["near_next"] == 1
    d = docs(odd)
    assert set(d.columns) < set(syncmers.fingerprints(d).columns) and syncmers.fingerprints(d).count() == len(odd)


def test_likenesses_are_of_all_anchors(docs):
    rnd = random.Random(8)
    make = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = make(50)
    rows = [(i, f"{make(3000)} {passage} {make(3000)}") for i in range(4)] + [(9, make(20))]
    out = {r["doc_id"]: r for r in syncmers.compare_with_edited(docs(rows)).collect()}
    sets = {i: {h >> 32 for h in syncmers.anchors(syncmers._code_points(t))[0].tolist()} for i, t in rows}
    for (i, t), (j, following) in zip(rows, rows[1:] + rows[:1]):
        other = {h >> 32 for h in syncmers.anchors(syncmers._code_points(syncmers.edited(t, following)))[0].tolist()}
        assert out[i]["near_next"] == len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert out[i]["near_edited"] == len(sets[i] & other) / len(sets[i] | other)
    assert all(0 < out[i]["near_next"] < 0.02 for i in range(3))  # fifty words of six thousand
    assert len(out[0]["fingerprint"]) > 4 * 8 * syncmers.SKETCH and len(out[9]["fingerprint"]) <= 8 * syncmers.SKETCH


def held_out(spark, column):
    """Labels of even ids to train on, the others to test with."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").select("doc_id", F.col(column).alias("want"))


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("want"))
    chain = toxicity.train(toxicity.labelled_sample(docs, train), ["toxic"])
    assert chain.categories == ["kind_1", "kind_2", "toxic"]
    got = toxicity.score(docs, chain).join(test.where("want is not null"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("toxic", "want", "lang").collect()
    toxic = [r for r in got if r["want"]]
    assert sum(r["toxic"] for r in toxic) >= 0.9 * len(toxic) > 100
    other = [r for r in toxic if r["lang"] != "en"]
    assert sum(r["toxic"] for r in other) >= 0.85 * len(other) > 50
    assert sum(r["toxic"] and not r["want"] for r in got) <= 0.005 * len(got)


def test_a_chain_of_given_categories_uses_earlier_ones(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(600):
        a, b = i % 3 == 0, i % 4 == 0
        said = ["alpha"] * a + ["beta"] * b + [f"w{rnd.randrange(40)}x" for _ in range(12)]
        rows.append((i, " ".join(said), int(a), int(b), int(a or b)))
    d = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, either int")
    chain = toxicity.train(d, ["a", "b", "either"])
    assert len(chain.weights[2]) == chain.size + 2 + 1 and max(chain.weights[2][chain.size : -1]) > 0.5
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(d, chain).collect()}
    assert all(got[i] == bool(e) for i, *_, e in rows)


def test_clusters_part_what_differs_and_keep_their_order():
    x = toxicity.Rows([[0, 1, 2]] * 20 + [[3, 4, 5]] * 10, 6)
    every = np.ones(30, bool)
    c = toxicity.clusters(x, every)
    kind = toxicity.nearest(x, c)
    assert kind.tolist() == [0] * 20 + [1] * 10
    some = (np.arange(30) >= 5) & (np.arange(30) < 28)
    assert toxicity.nearest(x, toxicity.clusters(x, some, c)).tolist() == kind.tolist()
    assert toxicity.clusters(toxicity.Rows([[0]], 2), np.ones(1, bool), kinds=3).shape == (3, 2)
    same = toxicity.Rows([[0, 1]] * 4, 3)
    assert set(toxicity.nearest(same, toxicity.clusters(same, np.ones(4, bool))).tolist()) == {0}
    rnd = random.Random(1)
    mixed = [sorted(rnd.sample(range(8 * (i % 3 == 0), 8 * (i % 3 == 0) + 8), 4)) for i in range(90)]
    y = toxicity.Rows(mixed, 16)
    found = toxicity.nearest(y, toxicity.clusters(y, np.ones(90, bool)))
    assert len(set(found[::3])) == 1 and found[0] != found[1] and len(set(found[i] for i in range(90) if i % 3)) == 1


def test_toxicity_of_odd_rows(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(toxicity.labelled_sample(docs(odd), none), ["toxic"])
    assert not any(r["toxic"] for r in toxicity.score(docs(odd), chain).collect() if r["p_toxic"] < 0.5)
    some = spark.createDataFrame([(4, 1), (6, 0), (7, None), (1, 0), (5, 0), (5, 1)], "doc_id long, toxic int")
    sampled = toxicity.labelled_sample(docs(odd), some)
    assert sorted((r["doc_id"], r["toxic"]) for r in sampled.collect()) == [(1, 0), (4, 1), (5, 1), (6, 0)]
    chain = toxicity.train(sampled, ["toxic"])
    out = toxicity.score(docs(odd), chain)
    assert out.columns == ["doc_id", "p_kind_1", "p_kind_2", "p_toxic", "toxic"] and out.count() == len(odd)
    assert toxicity.score(docs([]), chain).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, train, test = held_out(spark, "quality")
    got = quality.judge(docs, train, F.col("source"), F.col("lang")).join(test, "doc_id").select("keep", "want").collect()
    assert sum(r["keep"] == bool(r["want"]) for r in got) > 0.95 * len(got)
    assert sum(not r["keep"] and r["want"] for r in got) <= 0.02 * len(got)


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [(i, "good", "good/a", [1.0 if i % 10 else 0.0]) for i in range(400)] + [(1000, "bad", "bad/a", [0.0]), (1001, "bad", "bad/a", [0.0]), (1002, None, None, [1.0])]
    f = spark.createDataFrame(rows, "id long, host string, path string, x array<double>")
    out = {r["id"]: r for r in quality.posteriors(f, np.array([6.0]), -3.0).collect()}
    assert len(out) == len(rows)
    assert out[1000]["host_quality"] < out[1]["host_quality"] and out[1000]["host_quality"] > 0.05 and out[1000]["path_quality"] > 0.05
    assert out[1]["keep"] and not out[1000]["keep"] and out[1002]["keep"]


def brute_posteriors(rows, low, high):
    """Host and path posterior means by analysis of variance in plain loops; rows of host, path, probability."""
    n, mean = len(rows), sum(p for *_, p in rows) / len(rows)
    by_host, by_path = defaultdict(list), defaultdict(list)
    for h, q, p in rows:
        by_host[h].append(p)
        by_path[h, q].append(p)
    average = lambda x: sum(x) / len(x)

    def strength(groups, parent, parents, spread):
        within = sum((p - average(g)) ** 2 for g in groups.values() for p in g) / (n - len(groups))
        between = sum(len(g) * (average(g) - parent(k)) ** 2 for k, g in groups.items())
        true = (between - (len(groups) - parents) * within) / spread
        return high if true <= 0 else min(high, max(low, within / true))

    kh = strength(by_host, lambda _: mean, 1, n - sum(len(g) ** 2 for g in by_host.values()) / n)
    kp = strength(by_path, lambda k: average(by_host[k[0]]), len(by_host), n - sum(len(g) ** 2 / len(by_host[k[0]]) for k, g in by_path.items()))
    out = []
    for h, q, p in rows:
        host = (sum(by_host[h]) - p + kh * mean) / (len(by_host[h]) - 1 + kh)
        out.append((host, (sum(by_path[h, q]) - p + kp * host) / (len(by_path[h, q]) - 1 + kp)))
    return out, kh, kp


def test_posteriors_match_brute_force_on_sparse_sites(spark):
    rng = np.random.default_rng(3)
    rows, x = [], []
    for h in range(60):
        level = rng.beta(4, 2)
        for q in range(rng.integers(1, 4)):
            own = np.clip(level + rng.normal(0, 0.1), 0.02, 0.98)
            for _ in range(rng.integers(1, 5)):
                x.append(float(rng.normal(np.log(own / (1 - own)), 1.5)))
                rows.append((f"h{h}", f"h{h}/{q}", 1 / (1 + np.exp(-x[-1]))))
    want, kh, kp = brute_posteriors(rows, *quality.STRENGTH)
    assert quality.STRENGTH[0] < kh < 100
    f = spark.createDataFrame([(i, h, q, [x[i]]) for i, (h, q, _) in enumerate(rows)], "id long, host string, path string, x array<double>")
    got = {r["id"]: r for r in quality.posteriors(f, np.array([1.0]), 0.0).collect()}
    for i, (host, path) in enumerate(want):
        assert got[i]["host_quality"] == pytest.approx(host, abs=1e-9) and got[i]["path_quality"] == pytest.approx(path, abs=1e-9)


def test_spread_that_chance_explains_shrinks_to_the_mean(spark):
    """Sites of two documents that don't differ: raw means spread widely, posteriors hardly."""
    rng = np.random.default_rng(5)
    f = spark.createDataFrame([(i, f"h{i // 2}", f"h{i // 2}/", [float(rng.normal(0, 2))]) for i in range(600)], "id long, host string, path string, x array<double>")
    got = quality.posteriors(f, np.array([1.0]), 0.0).agg(F.stddev("host_quality"), F.stddev("evidence")).first()
    assert got[0] < 0.15 * got[1]


def test_quality_by_hosts_and_paths_of_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    host, path = quality.url_site("url")
    labels = pages.select(F.col("page_id").alias("doc_id"), F.when(F.length("html") > 600, 1).otherwise(0).alias("quality")).where("doc_id % 2 = 0")
    out = quality.judge(pages.withColumnRenamed("html", "text"), labels.withColumnRenamed("doc_id", "page_id"), host, path, "page_id").collect()
    assert len(out) == pages.count() and len({r["host"] for r in out}) > 1 and len({r["path"] for r in out}) >= len({r["host"] for r in out})
    assert all(0 < r["path_quality"] < 1 and 0 < r["quality"] < 1 for r in out)


def test_quality_of_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (8, None), (4, 1)], "doc_id long, quality int")
    d = docs(odd)
    out = quality.judge(d, labels, F.col("source"), F.col("lang"))
    assert out.count() == len(odd)
    kept = quality.filter_documents(d, labels, F.col("source"), F.col("lang"))
    assert kept.columns == d.columns and kept.count() <= len(odd)
    none = labels.where("false")
    assert quality.filter_documents(docs([]), none, F.col("source"), F.col("lang")).count() == 0
    assert quality.judge(d, none, F.col("source"), F.col("lang")).select("evidence").distinct().count() == 1
    u = spark.createDataFrame([("HTTP://Ex.org/a/b?c", ), (None,)], "url string").select(*quality.url_site("url")).collect()
    assert tuple(u[0]) == ("ex.org", "ex.org/a") and tuple(u[1]) == (None, None)


def test_linear_models():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(float)
    w, b = linear.fit_dense(x, y)
    assert ((x @ w + b > 0) == y).mean() > 0.97
    rows = [[0] if v else [1] for v in y]
    p = linear.sigmoid(linear.Sparse(rows, 2).dot(linear.fit_sparse(linear.Sparse(rows, 2), y)))
    assert ((p > 0.5) == y).all() and 0.1 < linear.best_threshold(p, y) < 0.9
    assert linear.best_threshold(np.zeros(0), np.zeros(0)) == 0.5 and linear.fit_dense(x, np.ones(500))[0].tolist() == [0, 0]


def test_scratch_folder(spark):
    assert shared.scratch_path(spark, "a") != shared.scratch_path(spark, "a")
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


@pytest.mark.parametrize("name", ["Text", "x"])
def test_fresh_names(docs, name):
    assert shared.fresh(docs([]), name) == {"Text": "_Text", "x": "x"}[name]
