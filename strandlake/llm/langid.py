"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 characters of the lower-cased text, runs of
characters that aren't letters as one blank) per language over all training rows: every
task adds up its own sparse counts, one grouped sum merges them, and what reaches the
driver is at most languages x buckets cells.  The matrix of log-probabilities is broadcast;
its size is languages x buckets x 4 bytes and is checked against ``MAX_MATRIX_BYTES``, the
buckets being halved until it fits.  Scoring is one pass over the texts: n-grams are hashed
with numpy over many texts at once and the rows of the matrix are added up by text.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is
every text if nothing was learned.  Equal scores go to the language that sorts first.
Repeated rows get equal results; a null id counts as the empty text where ids are hashed.
Further columns pass, whatever their names; the result's ``lang_pred`` and ``score`` take the
place of input columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import chunks, crc_mod, documents, without, slices, with_text

UNKNOWN = "und"
BUCKETS = 1 << 15
MAX_MATRIX_BYTES = 64 << 20
ORDERS = 3
#: Additive smoothing of the n-gram counts, and the weight of an n-gram: neighbouring
#: n-grams overlap, so that each counts for less than an independent observation.
ALPHA, WEIGHT = 0.1, 0.2
CHUNK_CHARS = 1 << 19
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MUL = np.uint32(0x9E3779B1)


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text that each belongs to, and texts with a letter."""
    clean = [_OTHER.sub(" ", t.lower()) for t in texts]
    has = np.array([_LETTER.search(c) is not None for c in clean], bool)
    sizes = np.array([len(c) + 3 for c in clean], np.int64)
    code = np.frombuffer("".join([f" {c} \n" for c in clean]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = code > 32
    cells, rows = [], []
    h = np.zeros(len(code), np.uint32)
    for order in range(ORDERS):
        tail = code[order:]
        h = (h[: len(tail)] * _MUL + tail) * _MUL
        h ^= h >> np.uint32(15)
        ok = tail != 10
        ok &= row[order:] == row[: len(tail)]
        ok &= letter if order == 0 else True
        cells.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(7))[ok] & np.uint32(buckets - 1))
        rows.append(row[: len(tail)][ok])
    return np.concatenate(cells), np.concatenate(rows), has


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in slices(batches, 1):
            lang, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks([len(t) for t in text], CHUNK_CHARS):
                cell, row, _ = grams(text[i:j], buckets)
                names = sorted(set(lang[i:j]))
                own = np.array([names.index(x) for x in lang[i:j]])[row]
                found = np.bincount(own * buckets + cell, minlength=len(names) * buckets).reshape(-1, buckets)
                for name, counts in zip(names, found):
                    total[name] = total[name] + counts if name in total else counts
            for x in lang:
                rows[x] = rows.get(x, 0) + 1
        for name, counts in total.items():
            at = np.append(np.nonzero(counts)[0], -1)  # bucket -1 counts documents
            n = np.append(counts[at[:-1]], rows[name])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "cell", "n"])

    return run


class Model:
    """Languages, in order, with their log prior and log-probabilities of the buckets."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray):
        self.langs, self.prior, self.table = langs, prior, table

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for i, j in chunks([len(t) for t in texts], CHUNK_CHARS):
            out += self._score(texts[i:j])
        return out

    def _score(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        cell, row, has = grams(texts, self.table.shape[1])
        logp = np.stack([np.bincount(row, lang[cell], minlength=len(texts)) for lang in self.table], axis=1)
        logp = WEIGHT * logp + self.prior
        best = logp.argmax(axis=1)
        top = logp.max(axis=1)
        share = 1 / np.exp(logp - top[:, None]).sum(axis=1)
        return [(self.langs[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, share, has)]


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", *, buckets: int = BUCKETS) -> Model:
    """Learn from the rows that have both a text and a language."""
    d = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    n_langs = max(1, d.select(F.approx_count_distinct("lang", 0.02)).first()[0])
    while buckets > 256 and n_langs * buckets * 4 > MAX_MATRIX_BYTES:
        buckets //= 2
    if n_langs * buckets * 4 > 2 * MAX_MATRIX_BYTES:
        raise ValueError(f"{n_langs} languages: the model would be over {MAX_MATRIX_BYTES} bytes")
    counts = d.mapInArrow(_count(buckets), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), buckets))
    docs = np.zeros(len(langs))
    place = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    cell, n = counts["cell"].to_numpy(), counts["n"].to_numpy()
    table[place[cell >= 0], cell[cell >= 0]] = n[cell >= 0]
    docs[place[cell < 0]] = n[cell < 0]
    if langs:
        table = np.log(table + ALPHA) - np.log(table.sum(axis=1, keepdims=True) + ALPHA * buckets)
    prior = np.log(docs / docs.sum()) if langs else docs
    return Model(langs, prior, table.astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", *, min_score: float | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language.

    With ``min_score``, ``docs`` as they are, without the rows whose score isn't over it.
    """
    return _scored(docs, model, docs.columns, text_col, min_score)


def _scored(docs: DataFrame, model: Model, keep: list[str], text_col: str, min_score: float | None = None) -> DataFrame:
    """The columns ``keep`` and the prediction; a batch is cut into slices of ``CHUNK_BYTES`` of text."""
    new = () if min_score is not None else ("lang_pred", "score")
    keep = without(keep, *new)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d, at = with_text(docs, text_col)
    own = [d.columns.index(c) for c in keep]
    found = d.select(*keep)
    kind = found.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema if new else found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            lang, score = zip(*shared.value.score([t or "" for t in b.column(at).to_pylist()]))
            kept = b.select(own)
            if new:
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *new])
            else:
                yield kept.filter(pa.array([s > min_score for s in score], pa.bool_()))

    return d.mapInArrow(run, kind)


def training_rows(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) != 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(training_rows()))
    held = docs.select("doc_id", (~training_rows()).alias("held_out"), "text")
    return _scored(held, model, ["doc_id", "held_out"], "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: drop documents of no known language, or none with a posterior over ``min_score``.

    The model is learned from the stage's own labelled rows, as in the query.
    """
    model = train(docs.where(training_rows()))
    return predict(docs, model, min_score=min_score)
