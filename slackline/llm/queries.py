"""The queries of this subpackage: each applies an operator with production parameters to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm import best_fit, bpe, exact_dedup, importance, packing, pii, quality, runs, sharding, shared, simhash, suffix_dedup, syncmers, toxicity


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded, then decoded."""
    docs = shared.documents(spark, sf_dir)
    coded = docs.select("doc_id", bpe.round_trip(shared.text_or_empty()).alias("c"))
    return coded.select("doc_id", (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"), F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = sharding.shard(shared.documents(spark, sf_dir), shards=16)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts; the largest doc_id stays."""
    return exact_dedup.classes(shared.documents(spark, sf_dir), keep="largest")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; the counts by kind are of base spans, ``n_spans`` is of all."""
    found = pii.detect(shared.documents(spark, sf_dir).select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, pii.KINDS), F.sha2(listed("pii.base"), 256).alias("base_sha256"), listed("pii.spans").alias("spans"), F.size("pii.spans").cast("long").alias("n_spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a chain trained on a bounded sample of labels."""
    docs, labels = shared.documents(spark, sf_dir), shared.documents(spark, sf_dir, "labels")
    chain = toxicity.train(toxicity.labelled_sample(docs, labels), ["toxic"])
    return toxicity.score(docs, chain)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from all documents because an earlier one has the same 50."""
    found = suffix_dedup.remove_repeats(shared.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of all documents and of their edited texts."""
    return syncmers.compare_with_edited(shared.documents(spark, sf_dir), texts=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components that they link."""
    out = simhash.near_duplicates(shared.documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; the source is the host, a source's language its path."""
    docs, labels = shared.documents(spark, sf_dir), shared.documents(spark, sf_dir, "labels")
    return quality.judge(docs, labels, F.col("source"), F.col("lang"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents concatenated and cut into windows of 2048 tokens."""
    return packing.piece_checksums(shared.documents(spark, sf_dir))


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into as few windows of 2048 tokens as best-two-fit needs."""
    return best_fit.piece_checksums(shared.documents(spark, sf_dir))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents; every tenth by a checksum of its id is made periodic from a word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    periodic = (h % 10 == 0) & (F.size("words") > 0)
    docs = shared.documents(spark, sf_dir).select("doc_id", shared.text_or_empty().alias("text"), h.alias("h"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    docs = docs.withColumn("words", words).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(periodic, F.col("g") % F.size("words")))
    docs = docs.withColumn("p", 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8)))
    made = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    found = runs.detect(docs.select("doc_id", F.when(periodic, F.array_join(made, " ")).otherwise(F.col("text")).alias("text")))
    lines = F.array_join(F.transform("periodic.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("periodic.runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    digests = F.size("periodic.runs").cast("long").alias("n_runs"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256")
    best = found.select("doc_id", runs.greatest(F.col("periodic.runs")).alias("best"), *digests)
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words and pairs of words."""
    drawn = importance.resample(shared.documents(spark, sf_dir), shared.documents(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_bpe": op1_bpe, "op2_shard": op2_shard, "op3_exact": op3_exact, "op4_pii": op4_pii, "op5_toxicity": op5_toxicity, "op6_suffix": op6_suffix, "op7_syncmers": op7_syncmers, "op8_simhash": op8_simhash, "op9_quality": op9_quality, "op10_pack": op10_pack,
    "op11_best_two_fit": op11_best_two_fit, "op12_runs": op12_runs, "op13_importance": op13_importance}

#: DuckDB SQL by query, where SQL can express it on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_exact": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    # strings' CRC-32 four bits at a time, over distinct strings
    "op13_importance": r"""
        WITH t AS (SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS t),
        texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
        split AS (
            SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM texts
        ),
        grams AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM split),
        counted AS (SELECT side, id, g, count(*) AS n FROM grams GROUP BY ALL),
        strings AS (SELECT g, hex(g) AS h, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted GROUP BY g),
        hashed AS (
            SELECT g, s, strings.t AS t, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(len(h)), lambda i: instr('123456789ABCDEF', substr(h, 2 * (i // 2) + 2 - i % 2, 1)))),
                lambda c, x: xor(c >> 4, tab.t[(xor(c, x) & 15) + 1]))) % 10000 AS bucket
            FROM strings, t AS tab
        ),
        sums AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM sums),
        weighed AS (
            SELECT id, sum(n) AS n, floor(sum(n * gain) / sum(n)) AS weight
            FROM counted JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
        ),
        noisy AS (
            SELECT id, len(w) AS words, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: instr('123456789abcdef', substr(sha256('7:' || id), i, 1)))), lambda c, x: c * 16 + x) AS h
            FROM split WHERE side = 0
        ),
        scored AS (
            SELECT id, words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS score
            FROM noisy LEFT JOIN weighed USING (id)
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, id) AS place, count(*) FILTER (words >= 20) OVER () AS large FROM scored)
        SELECT id AS doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
               CASE WHEN words >= 20 AND place <= 25 * large // 100 THEN place END AS rank
        FROM placed
    """,
}
