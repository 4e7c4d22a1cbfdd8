"""Quality by hierarchical empirical Bayes over hosts and paths.

1. A logistic regression over surface features of each whole text gives the document's evidence. It is fitted on
   a bounded sample of labelled rows.
2. Its probabilities and their squares are summed by path, over all documents. How far hosts differ, and paths
   within hosts, beyond what their documents' own spread explains, sets the strength of two priors by moments: a
   host's posterior mean is shrunk to the global mean, a path's to its host's, the more the fewer documents it has.
   A prior weighs as many documents as the variance within sites is larger than that between them. A document's
   own probability is left out.
3. A document's posterior log odds are its evidence with the global prior exchanged for its path's.

Sums are partial before the shuffle, so a host with a third of all rows costs no more than its groups.

Contract: a null text counts as empty; an empty text is judged by its features like any other; a null host or
path is a group of its own; rows with null labels don't train; without labels, or with one class, every document
gets the smoothed prior; an id labelled both ways counts as 0; an empty table gives no rows; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.llm import linear, shared

#: Labelled rows that train the document classifier, at most, in order of a hash.
SAMPLE_ROWS = 20_000
#: A document stays from this posterior on.
THRESHOLD = 0.5
#: Bounds of the priors' strength, in documents.
STRENGTH = (2.0, 10_000.0)
#: Site means are held off 0 and 1 by this much, so that no site alone decides.
CLEAR = 0.02

FEATURES = ("signs", "bangs", "bars", "capitals", "digits", "high_bytes", "repeated_words", "distinct_words", "word_length", "log_words", "packed", "repeated_lines")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def text_features(text: str) -> list[float]:
    """Surface features of a whole text, from passes that run in C."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    words = data.split()
    k = max(1, len(words))
    lines = data.split(b"\n")
    capitals = len(data) - len(data.translate(None, _LETTERS[:26]))
    letters = max(1, len(data) - len(data.translate(None, _LETTERS)))
    return [
        share(b"#$%&*+=<>@[]^_`{}~\\/"),
        share(b"!?"),
        share(b"|"),
        capitals / letters,
        share(b"0123456789"),
        share(bytes(range(128, 256))),
        sum(map(bytes.__eq__, words, words[1:])) / k,
        len(set(words)) / k,
        len(data) / k,
        float(np.log1p(len(words))),
        min(2.0, len(zlib.compress(data, 1)) / n),
        1 - len(set(lines)) / len(lines),
    ]


def url_site(url: str | Column) -> tuple[Column, Column]:
    """Host and path (host and first directory) of a URL column."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return host, F.concat(host, F.lit("/"), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1))


def featured(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, host, path and the features of every document, written once: a row is small whatever the text."""
    shared.session(docs)

    def rows(batches):
        import pyarrow as pa

        shared.working("quality")
        for b in batches:
            x = [text_features(t or "") for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "host", "path", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    return shared.table(chosen.mapInArrow(rows, f"id {kind}, host string, path string, x array<double>"), "quality-features")


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", target: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the document classifier."""
    chosen = labels.where(F.col(target).isNotNull()).groupBy(id_col).agg(F.min(target).alias(target)).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    key, y = shared.fresh(features, "label_id"), shared.fresh(features, "label")
    chosen = F.broadcast(chosen.select(F.col(id_col).alias(key), F.col(target).cast("double").alias(y)))  # ``rows`` rows
    got = features.join(chosen, F.col("id") == F.col(key)).orderBy(F.xxhash64("id"), "id").select("x", y).limit(rows).collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return linear.fit_dense(x, np.array([r[y] for r in got], float))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(CLEAR), F.least(F.lit(1 - CLEAR), p))
    return F.log(p / (1 - p))


def _strength(between: float, within: float, n: float, groups: float, parents: float, spread: float) -> float:
    """Weight of a prior in documents, clipped: variance within groups over the variance of their true means.

    ``between`` and ``within`` are sums of squares, of group means about their parents' and of ``n`` documents about
    their groups'; ``spread`` is n less the sum over groups of squared size over the parent's.
    """
    if n <= groups or groups <= parents or spread <= 0:
        return STRENGTH[1]
    variance = max(0.0, within) / (n - groups)
    true = (between - (groups - parents) * variance) / spread
    return STRENGTH[1] if true <= 0 else min(STRENGTH[1], max(STRENGTH[0], variance / true))


def strengths(t: dict) -> tuple[float, float, float]:
    """Global mean, strength of the hosts' prior and of the paths', from the sums that ``posteriors`` takes."""
    n = t["n"]
    if not n:
        return 0.5, STRENGTH[1], STRENGTH[1]
    hosts = _strength(t["host_squares"] - t["s"] ** 2 / n, t["q"] - t["host_squares"], n, t["hosts"], 1, n - t["host_sizes"] / n)
    paths = _strength(t["path_squares"] - t["host_squares"], t["q"] - t["path_squares"], n, t["paths"], t["hosts"], n - t["path_sizes"])
    return t["s"] / n, hosts, paths


def posteriors(features: DataFrame, weights: np.ndarray, intercept: float, threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, evidence, host_quality, path_quality, quality, keep for every document."""
    z = F.lit(float(intercept))
    for i, w in enumerate(weights.tolist()):
        z = z + F.col("x")[i] * F.lit(w)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    scored = features.select("id", "host", "path", z.alias("z"), (1 / (1 + F.exp(-z))).alias("p"))
    paths = shared.table(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").alias("n")), "quality-paths")
    hosts = paths.groupBy(F.col("host").alias("of")).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"), F.sum("q").alias("hq"), F.count("*").alias("hp"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ps"), F.sum(F.col("n") * F.col("n")).alias("pn"))
    hosts = shared.table(hosts, "quality-hosts")
    sums = {"n": "hn", "s": "hs", "q": "hq", "paths": "hp", "host_squares": "hs * hs / hn", "path_squares": "ps", "host_sizes": "hn * hn", "path_sizes": "pn / hn"}
    total = hosts.agg(F.count("*").alias("hosts"), *(F.expr(f"sum(double({x}))").alias(name) for name, x in sums.items())).first().asDict()
    mean, host_strength, path_strength = strengths(total)
    sites = paths.join(hosts, paths["host"].eqNullSafe(F.col("of"))).select(F.struct("host", "path").alias("site"), "s", "n", "hs", "hn")
    joined = scored.join(sites, F.struct(scored["host"], scored["path"]).eqNullSafe(sites["site"]))
    host_mean = (F.col("hs") - F.col("p") + host_strength * mean) / (F.col("hn") - 1 + host_strength)
    path_mean = (F.col("s") - F.col("p") + path_strength * F.col("host_quality")) / (F.col("n") - 1 + path_strength)
    prior = float(np.log(max(CLEAR, min(1 - CLEAR, mean)) / (1 - max(CLEAR, min(1 - CLEAR, mean)))))
    out = joined.withColumn("host_quality", host_mean).withColumn("path_quality", path_mean)
    out = out.withColumn("quality", 1 / (1 + F.exp(-(F.col("z") - prior + _logit(F.col("path_quality"))))))
    return out.select("id", "host", "path", F.col("p").alias("evidence"), "host_quality", "path_quality", "quality", (F.col("quality") >= threshold).alias("keep"))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``posteriors`` of ``docs``, with the classifier fitted on ``labels``."""
    features = featured(docs, host, path, id_col, text)
    return posteriors(features, *fit(features, labels, id_col)).withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay. An id is judged once for all its rows that share a path: the best stays."""
    key = shared.fresh(docs, "kept_id")
    stay = judge(docs, labels, host, path, id_col, text).where("keep").select(F.col(id_col).alias(key)).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(F.col(key)), "left_semi")
