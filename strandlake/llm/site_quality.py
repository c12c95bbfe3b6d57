"""Quality and toxicity by hierarchical empirical Bayes over documents, paths and hosts.

Document evidence: a logistic regression over hashed features (the set of a text's words, and
classes of its shape: shares of symbols, capitals, distinct and repeated words).  It is fitted on at most ``max_labels`` labelled
rows, those with the least hash of their id; that sample is the only thing about rows that is
broadcast.  Of the features, those whose share among positive rows differs from that among
others by ``MIN_Z`` standard errors count, ``MAX_FEATURES`` at most, so that words of no bearing
add no noise.  A document's evidence is its log-odds less those of the sample.

Hierarchy: grouped aggregation adds up the documents' own posteriors by path and by host over
all documents.  A host's rate is its mean shrunk towards the global rate, a path's its mean
shrunk towards its host's; the strength of either prior (how many documents it is worth) comes
from the spread of the groups' means by the method of moments.  A document's own share is
taken out of its groups' sums, so that it isn't counted twice.  The final posterior joins the
document's evidence with its path's rate in place of the global prior.

Groups are summed with map-side combine and come back to the (narrow) document rows by
equi-joins, which adaptive execution splits for a hot host; nothing grows on the driver.

Defined results: a null or empty text has the evidence of an empty feature set; a null host or
path is a group of its own; repeated rows count each; a document labelled twice counts as
positive if any label is, and of labelled documents of one id the least text is learned from; without labels of both kinds there is no evidence and the global
rate is one half.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import crc_mod, documents, slices, utf8
from strandlake.plans.scratch import Scope, materialize

BUCKET_BITS = 18
MAX_LABELS = 20_000
MAX_FEATURES, MIN_Z = 512, 5.0
TARGETS = ("quality", "toxic")
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>"
_SHAPES = (b"#*$%&", b"|>", b"!", b"0123456789")


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct buckets of a text's words and shape."""
    text = text or b""
    low = text.lower()
    split = low.split()
    words = {w.strip(_STRIP) for w in split}
    distinct = b"\ndistinct/%d" % int(10 * len(words) / max(1, len(split)))
    same = b"\nsame/%d" % min(9, int(20 * sum(map(eq, split, split[1:])) / max(1, len(split))))
    size = max(1, len(text))
    shape = [b"\n%d/%d" % (i, min(9, int(40 * sum(map(text.count, (bytes([c]) for c in chars))) / size))) for i, chars in enumerate(_SHAPES)]
    shape.append(b"\ncase/%d" % _case(text, low, size))
    words.update(shape)
    if len(split) >= 10:  # the shares say nothing about a few words
        words.update((distinct, same))
    mask = (1 << BUCKET_BITS) - 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(w, 7) & mask for w in words), np.int64, len(words)))


def _case(text: bytes, low: bytes, size: int) -> int:
    """Tenths of the bytes that are capital letters A-Z."""
    a, b = np.frombuffer(text, np.uint8), np.frombuffer(low, np.uint8)
    return min(9, int(10 * int((a != b).sum()) / size))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        own = [features(t).astype(np.int32) for t in utf8(b.column(1))]
        ends = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*own, np.zeros(0, np.int32)])))], ["id", "cells"])


class Evidence:
    """For each target the prior log-odds, the sum for a text without features, and weights by bucket."""

    def __init__(self, prior: np.ndarray, base: np.ndarray, table: np.ndarray):
        self.prior, self.base, self.table = prior, base, table

    def of(self, text: bytes | None) -> np.ndarray:
        return self.base + self.table[features(text)].sum(axis=0)


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> DataFrame:
    """``(id, cells, quality, toxic)`` of at most ``max_labels`` labelled documents, a row for each id.

    The ids are found before any text is looked at; of documents of one id the least text counts.
    """
    targets = [F.max(F.when(F.col(t) > 0, 1).otherwise(0)).alias(t) for t in TARGETS]
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*targets)
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_labels)  # 16 bytes a row, and bounded by the parameter
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = d.join(F.broadcast(own.select("id")), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return texts.mapInArrow(_cells, "id long, cells array<int>").join(own, "id")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> Evidence:
    width = len(TARGETS)
    prior, base, table = np.zeros(width), np.zeros(width), np.zeros((1 << BUCKET_BITS, width))
    with Scope(docs.sparkSession) as scope:
        rows = scope.table(sample(docs, labels, id_col=id_col, text_col=text_col, max_labels=max_labels), "labelled")
        total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()
        each = rows.select(F.explode("cells").alias("cell"), *TARGETS)
        counts = scope.table(each.groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]), "features")
        chosen: dict[int, np.ndarray] = {}
        for k, t in enumerate(TARGETS):
            pos, neg = total[t], total["n"] - total[t]
            if not pos or not neg:
                continue
            a, b = F.col(t) / F.lit(pos), (F.col("n") - F.col(t)) / F.lit(neg)
            share = F.col("n") / F.lit(total["n"])
            z = F.abs(a - b) / F.sqrt(share * (1 - share) * F.lit(1 / pos + 1 / neg) + F.lit(1e-12))
            top = counts.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "cell").limit(MAX_FEATURES)
            chosen[k] = np.array(sorted(r["cell"] for r in top.select("cell").collect()), np.int64)
        if not chosen:
            return Evidence(prior, base, table)
        wanted = np.unique(np.concatenate(list(chosen.values())))
        kept = F.array_intersect("cells", F.lit(wanted.astype(np.int32)).cast("array<int>"))
        found = rows.select("id", *TARGETS, kept.alias("cells")).toArrow().combine_chunks()  # bounded by the parameters
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    found = found.take(pa.array(order)).combine_chunks()
    y = np.stack([found.column(t).to_numpy().astype(np.float64) for t in TARGETS], axis=1)
    cells = found.column("cells").combine_chunks()
    cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
    row = np.repeat(np.arange(len(y)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
    cell = cells.flatten().to_numpy().astype(np.int64)
    for k, own in chosen.items():
        at = np.searchsorted(own, cell)
        ok = (at < len(own)) & (own[np.minimum(at, max(0, len(own) - 1))] == cell) if len(own) else np.zeros(len(cell), bool)
        w, start = logistic(row[ok], at[ok], len(own), y[:, k])
        prior[k] = np.log(y[:, k].sum() / (len(y) - y[:, k].sum()))
        base[k] = start - prior[k]
        table[own, k] = w
    return Evidence(prior, base, table)


def logistic(row: np.ndarray, feature: np.ndarray, n: int, y: np.ndarray, *, ridge: float = 1e-5, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on 0/1 features, by Adam on the whole sample."""
    w, b = np.zeros(n), float(np.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, rounds + 1):
        miss = 1 / (1 + np.exp(-(np.bincount(row, w[feature], minlength=len(y)) + b))) - y
        g = np.append(np.bincount(feature, miss[row], minlength=n) / len(y) + ridge * w, miss.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            found = np.array([shared.value.of(t) for t in utf8(b.column(3))]).reshape(-1, len(TARGETS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(found[:, i]) for i in range(len(TARGETS)))], ["doc_id", "host", "path", "e_quality", "e_toxic"])

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, n: str, s: str, mean: Column) -> float:
    """Prior strength, in documents, from the spread of group means (method of moments), 1 to 1000."""
    m = F.col(s) / F.col(n)
    row = groups.agg(F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(F.col(n) * (m - mean) ** 2).alias("between"), F.sum(F.col(n) * mean * (1 - mean)).alias("within")).first()
    if not row["g"] or row["g"] < 2 or not row["n"]:
        return 20.0
    size = row["n"] / row["g"]
    p = row["within"] / row["n"]  # the variance of one document
    spread = (row["between"] / row["n"] - p / size) or 0.0
    return float(min(1000.0, max(1.0, p / spread - 1))) if spread > 1e-9 else 1000.0


def posteriors(docs: DataFrame, evidence: Evidence, *, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document and target: ``doc_*`` its own posterior, ``host_*`` and ``path_*`` rates, ``p_*`` all joined."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    d = d.mapInArrow(_evidence(shared), "doc_id long, host string, path string, e_quality double, e_toxic double")
    for k, t in enumerate(TARGETS):
        d = d.withColumn(f"doc_{t}", _expit(F.lit(float(evidence.prior[k])) + F.col(f"e_{t}")))
    d = materialize(d, "evidence")
    sums = [F.sum(f"doc_{t}").alias(f"s_{t}") for t in TARGETS]
    by_path = materialize(d.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS])
    rates = by_host.agg(*[(F.sum(f"h_{t}") / F.sum("hn")).alias(t) for t in TARGETS]).first()
    mean = {t: min(1 - 1e-6, max(1e-6, rates[t] if rates[t] is not None else 0.5)) for t in TARGETS}
    strengths = {t: (_strength(by_host, "hn", f"h_{t}", F.lit(mean[t])), _strength(by_path, "n", f"s_{t}", F.lit(mean[t]))) for t in TARGETS}
    groups = by_path.join(by_host.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    groups = groups.withColumnsRenamed({"host": "_host", "path": "_path"})
    out = d.join(groups, d["host"].eqNullSafe(groups["_host"]) & d["path"].eqNullSafe(groups["_path"]))
    for k, t in enumerate(TARGETS):
        own, (kh, kp) = F.col(f"doc_{t}"), strengths[t]
        out = out.withColumn(f"host_{t}", (F.col(f"h_{t}") - own + kh * mean[t]) / (F.col("hn") - 1 + kh))
        out = out.withColumn(f"path_{t}", (F.col(f"s_{t}") - own + kp * F.col(f"host_{t}")) / (F.col("n") - 1 + kp))
        rate = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(f"path_{t}")))
        out = out.withColumn(f"p_{t}", _expit(F.col(f"e_{t}") + _logit(rate)))
    return out.select("doc_id", "host", "path", *[f"{x}_{t}" for t in TARGETS for x in ("doc", "host", "path", "p")])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as host and its language section as path; a fifth of the ids is held out of fitting."""
    docs = documents(spark, sf_dir)
    held = crc_mod("doc_id", 5) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    path = F.concat_ws("/", "source", "lang")
    out = posteriors(docs, fit(docs, labels), host=F.col("source"), path=path)
    kept = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)
    return out.select("doc_id", held.alias("held_out"), "host", "path", "doc_quality", "host_quality", "path_quality", F.col("p_quality").alias("quality_score"), "doc_toxic", "host_toxic", "path_toxic", F.col("p_toxic").alias("toxic_score"), kept.alias("kept"))
