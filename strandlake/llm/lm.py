"""Language-model scoring with a log-frequency Bloom filter.

Tokens are the words of the text with A-Z in lower case, and one end token per document.
They travel as 64-bit hashes (XXH64), so that all joins and sums are on integers; two of V
words share a hash with a probability of about V * V / 2^65 in all.

Exact counts (the base score): counts of the training tokens are a grouped sum over all
documents.  The ``HEAD`` most frequent tokens are broadcast, a fixed number of rows; all other
tokens of a document meet their counts in a shuffled equi-join, and the parts are added up
by document.

The model: all unigrams, and all pairs of neighbouring tokens in training (a caller may leave out
those under ``least`` times).  Pairs are counted per chunk of text, sent packed to the bucket of their hash, and added
up there, bucket by bucket, so that a frequent word's pairs are spread over all buckets.
A count c is quantised to
1 + floor(log2 c) levels, and the filter holds (n-gram, 1) ... (n-gram, level), as in a
log-frequency Bloom filter: a look-up probes one level after the other until one is missing.
It also holds, for every token v, the sum of its pairs' quantised counts as a binary number: the
number of digits as a level, and each digit that is one as a member.  So all that the
model needs is read from the filter, and its probabilities add up to one.
An n-gram's probes lie in one segment of the filter, so segments are built apart, in tasks.
The filter grows with the n-grams: tasks write their segments to one file in the shared scratch
folder, and whoever probes it maps that file.  Only where the folder is not on a mounted file
system does the filter reach the driver and get broadcast.

P(w after v) = (q(v, w) + T(v) U(w)) / (S(v) + T(v)), with the filter's quantised counts q, S(v) the sum
of q(v, w) over all w, T(v) = max(q(v) - S(v), 0) + PRIOR, and U(w) = (q(w) + 0.5) / (sum of q + 0.5 (V + 1)).
Over all w and one unknown token this adds up to 1 for every v; false positives of the filter
(``FALSE_POSITIVES`` of absent n-grams) add q = 1 for one absent pair in so many.  score = sum of
log10 P; the first word follows an end token.

Defined results: a null or empty text is one end token; repeated rows count and are scored
each by itself; a null id counts as the empty text where ids are hashed; without training
tokens N = V = 0 and every token is unknown.  Further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import chunks, crc_mod, documents, slices, utf8
from strandlake.plans.scratch import Scope, hold, materialize, scratch_path

END = xxhash.xxh64_intdigest(b"\n", 0)
HEAD = 1 << 17
LEAST = 1
SEGMENT_BITS = 22
BITS_PER_KEY, PROBES = 16, 7
FALSE_POSITIVES = (1 - np.exp(-PROBES / BITS_PER_KEY)) ** PROBES  # 0.0007
PRIOR = 4.0
#: Pairs of a bucket, about; a bucket is added up at once.
BUCKET_PAIRS = 2_000_000
#: N-grams that are packed by segment at once.
PACKED_ROWS = 500_000
#: Rows of a bucket's sums that are handed on at once.
OUT_ROWS = 100_000
CHUNK_BYTES = 2 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: An n-gram and its level.
_GRAM = np.dtype([("h", "<u8"), ("k", "u1")])


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, one after the other, and where each text ends."""
    split = [(t or b"").lower().split() for t in texts]
    ends = np.cumsum([len(w) + 1 for w in split])
    flat = [x for w in split for x in (*w, b"\n")]
    return np.fromiter(map(xxhash.xxh64_intdigest, flat, repeat(0)), np.uint64, len(flat)), ends


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return (x ^ (x >> np.uint64(29))) * _C


def before(tok: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before every token; an end token comes before each text."""
    out = np.concatenate([np.full(min(1, len(tok)), END, np.uint64), tok[:-1]])
    if len(ends):
        out[ends[:-1]] = np.uint64(END)
    return out


def pairs(tok: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of (token before, token) for every token."""
    return mix(before(tok, ends) * _A + tok)


def _counted(text_column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_column, 4 * CHUNK_BYTES):
            h, n = np.unique(tokens(utf8(b.column(text_column)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def token_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, c)`` over all training rows."""
    d = train.select(F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_counted(0), "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def levels(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1


#: The count that a level stands for: the mean of those that are quantised to it.
VALUE = np.concatenate([[0.0], 1.5 * 2.0 ** np.arange(0, 62) - 0.5])


class LogFrequencyFilter:
    """Segments of bits; n-gram ``h`` at ``level`` sets PROBES bits of the segment of ``h``."""

    def __init__(self, segments: int, bits: int):
        self.segments, self.bits = segments, bits
        self.words = np.zeros(segments << (bits - 3), np.uint8)
        self.path = None

    def map(self, path: str) -> None:
        self.path, self.words = path, np.memmap(path, np.uint8, "r")

    def __getstate__(self) -> dict:
        return self.__dict__ if self.path is None else self.__dict__ | {"words": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.path is not None:
            self.map(self.path)

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (mix(h ^ _A) >> np.uint64(40)).astype(np.int64) % self.segments

    def _probes(self, h: np.ndarray, level: int) -> Iterator:
        """One function after the other that gives the bits of the rows ``at``."""
        x = mix(h + np.uint64(level * int(_C) & 0xFFFFFFFFFFFFFFFF))
        step = mix(x ^ _A) | np.uint64(1)
        for i in range(PROBES):
            yield lambda at, i=i: ((x[at] + step[at] * np.uint64(i)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def fill(self, h: np.ndarray, level: np.ndarray, own: np.ndarray) -> None:
        """Set the bits in ``own``, the bytes of the one segment that all of ``h`` belong to."""
        for k in range(1, int(level.max(initial=0)) + 1):
            on = h[level >= k]
            every = np.arange(len(on))
            for p in self._probes(on, k):
                p = p(every)
                np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, h: np.ndarray, level: int, base: np.ndarray) -> np.ndarray:
        """Which of the n-grams are held at ``level``; ``base`` is the first bit of their segments."""
        at = np.arange(len(h))
        for p in self._probes(h, level):
            p = p(at) + base[at]
            at = at[(self.words[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(h), bool)
        out[at] = True
        return out

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The level of every n-gram: the number of levels present in a row."""
        out = np.zeros(len(h), np.int64)
        base = self.segment(h) << self.bits
        at = np.argsort(base)  # segment by segment, as the whole filter is larger than the caches
        k = 0
        while len(at):
            k += 1
            at = at[self.has(h[at], k, base[at])]
            out[at] = k
        return out

    def totals(self, v: np.ndarray) -> np.ndarray:
        """S of the tokens, from the binary numbers that the filter holds in halves."""
        key = mix(v ^ _C)
        n = self.lookup(key)
        out = np.where(n > 0, 1 << np.maximum(n - 1, 0), 0)
        for i in range(int(n.max(initial=0)) - 1):
            at = np.nonzero(n > i + 1)[0]
            h = digit(key[at], i)
            out[at] += self.has(h, 1, self.segment(h) << self.bits).astype(np.int64) << i
        return out / 2


def digit(key: np.ndarray, i: int) -> np.ndarray:
    return mix(key + np.uint64((i + 1) * int(_B) & 0xFFFFFFFFFFFFFFFF))


def _total_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams ``(h, c)`` that stand for the binary numbers ``(v, s)``."""
    for b in batches:
        key, s = mix(b.column(0).to_numpy().view(np.uint64) ^ _C), b.column(1).to_numpy()
        h, c = [key], [s]
        for i in range(int(s.max(initial=0)).bit_length() - 1):
            on = ((s >> i) & 1 == 1) & (s >> (i + 1) > 0)  # the first digit is known from their number
            h.append(digit(key[on], i))
            c.append(np.ones(int(on.sum()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(c))], ["h", "c"])


def _by_bucket(bucket: np.ndarray, own: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for every bucket: its number, and its records of ``own`` packed."""
    order = np.argsort(bucket, kind="stable")
    bucket, own = bucket[order], own[order]
    cut = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0] if len(bucket) else np.zeros(0, np.int64)
    offsets = np.append(cut, len(own)).astype(np.int64) * own.dtype.itemsize
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(own.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), blobs.cast(pa.binary())], names)


def _pair_blobs(buckets: int):
    """Rows of a bucket number and its pairs of a chunk of text, packed: hash, token before and count of each."""
    kind = np.dtype([("h", "<u8"), ("v", "<u8"), ("n", "<u4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 8 * CHUNK_BYTES):
            tok, ends = tokens(utf8(b.column(0)))
            h, first, n = np.unique(pairs(tok, ends), return_index=True, return_counts=True)
            own = np.empty(len(h), kind)
            own["h"], own["n"] = h, n
            own["v"] = before(tok, ends)[first]
            yield _by_bucket((h >> np.uint64(20)).astype(np.int64) % buckets, own, ["bucket", "pairs"])

    return run


def _in_parts(kind: int, h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``(kind, h, c)`` in batches of ``OUT_ROWS``, as either side of the pipe holds a whole batch."""
    for i in range(0, len(h), OUT_ROWS):
        own = h[i : i + OUT_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.view(np.int64)), pa.array(c[i : i + OUT_ROWS])], ["kind", "h", "c"])


def _add_up(least: int):
    """Pairs with their counts, and for the tokens before them the sums of quantised counts, in halves (kind 1)."""
    kind = np.dtype([("h", "<u8"), ("v", "<u8"), ("n", "<u4")])

    def added(blobs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = np.concatenate(blobs)
        blobs.clear()  # the rows that they are views of
        order = np.argsort(own["h"], kind="stable")
        h = own["h"][order]
        first = np.nonzero(np.append(True, h[1:] != h[:-1]))[0]
        c = np.add.reduceat(own["n"][order], first, dtype=np.int64)
        first, c = first[c >= least], c[c >= least]
        h, v = h[first], own["v"][order[first]]
        del own, order, first
        yield from _in_parts(0, h, c)
        del h
        v, back = np.unique(v, return_inverse=True)
        s = np.bincount(back, 2 * VALUE[levels(c)], minlength=len(v)).astype(np.int64) if len(v) else np.zeros(0, np.int64)
        del back, c
        yield from _in_parts(1, v, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now and held:
                    yield from added(held)
                now = bucket
                held.append(np.frombuffer(blob.as_buffer(), kind))
        if held:
            yield from added(held)

    return run


def pair_counts(train: DataFrame, n_tokens: int, text_col: str = "text", *, least: int = LEAST) -> DataFrame:
    """``(kind, h, c)``: pairs that occur ``least`` times (kind 0), and parts of the totals of tokens in halves (kind 1)."""
    buckets = max(1, -(-n_tokens // BUCKET_PAIRS))
    blobs = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_pair_blobs(buckets), "bucket long, pairs binary")
    parts = max(1, min(buckets, 20_000))
    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_add_up(least), "kind int, h long, c long")


def _grams(shape: LogFrequencyFilter):
    """Rows of a segment and its n-grams of many rows ``(h, c)``, packed: hash and level of each."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, c = (np.concatenate(x) for x in zip(*held))
        own = np.empty(len(h), _GRAM)
        own["h"], own["k"] = h, levels(c)
        return _by_bucket(shape.segment(own["h"]), own, ["seg", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
            rows += b.num_rows
            if rows >= PACKED_ROWS:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    return run


def _build(shape: LogFrequencyFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1)):
                bits = own.setdefault(s, np.zeros(1 << (shape.bits - 3), np.uint8))
                grams = np.frombuffer(blob.as_buffer(), _GRAM)
                shape.fill(grams["h"], grams["k"], bits)
        for s, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([bits.tobytes()])], ["seg", "bits"])

    return run


def _write(path: str, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for b in batches:
                for seg, own in zip(b.column(0).to_pylist(), b.column(1)):
                    f.seek(seg * segment_bytes)
                    f.write(own.as_buffer())
                yield pa.RecordBatch.from_arrays([b.column(0)], ["seg"])

    return run


def build_filter(entries: DataFrame) -> LogFrequencyFilter:
    """A filter of all n-grams ``(h, c)``, with BITS_PER_KEY bits a level."""
    level = F.floor(F.log2("c")).cast("int") + 1
    sizes = entries.groupBy(level.alias("k")).count().collect()  # 62 rows at most
    need = max(1, sum(n * k for k, n in sizes) * BITS_PER_KEY)
    bits = min(SEGMENT_BITS, max(10, int(need - 1).bit_length()))
    out = LogFrequencyFilter(0, bits)
    shape = LogFrequencyFilter(0, bits)
    out.segments = shape.segments = n_seg = -(-need // (1 << bits))
    built = entries.select("h", "c").mapInArrow(_grams(shape), "seg long, grams binary").repartition("seg").mapInArrow(_build(shape), "seg long, bits binary")
    where = urlparse(scratch_path(entries.sparkSession, "filter"))
    if where.scheme in ("", "file"):
        path = unquote(where.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        hold(entries.sparkSession, where.geturl())
        with open(path, "wb") as f:
            f.truncate(n_seg << (bits - 3))
        built.mapInArrow(_write(path, 1 << (bits - 3)), "seg long").agg(F.count("*")).collect()
        out.map(path)
    else:
        out.words = np.zeros(n_seg << (bits - 3), np.uint8)
        found = built.toArrow()
        for seg, own in zip(found.column("seg").to_pylist(), found.column("bits")):
            out.words[seg << (bits - 3) : (seg + 1) << (bits - 3)] = np.frombuffer(own.as_buffer(), np.uint8)
    return out


class Model:
    def __init__(self, grams: LogFrequencyFilter, head_h: np.ndarray, head_c: np.ndarray, n: int, v: int, n_quantised: float):
        self.grams, self.head_h, self.head_c, self.n, self.v, self.n_quantised = grams, head_h, head_c, n, v, n_quantised

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def exact(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the tokens in the head, and which are there."""
        if not len(self.head_h):
            return np.zeros(len(tok), np.int64), np.zeros(len(tok), bool)
        at = np.minimum(np.searchsorted(self.head_h, tok), len(self.head_h) - 1)
        known = self.head_h[at] == tok
        return np.where(known, self.head_c[at], 0), known

    def unigram(self, q: np.ndarray) -> np.ndarray:
        """U of tokens of the quantised counts ``q``; they add up to 1 with one unknown token."""
        return (q + 0.5) / (self.n_quantised + 0.5 * (self.v + 1))

    def score(self, tok: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of the model's probability of every token after the one before it."""
        own, back = np.unique(np.append(tok, np.uint64(END)), return_inverse=True)
        q, s = VALUE[self.grams.lookup(own)], self.grams.totals(own)
        at, behind = back[:-1], np.concatenate([back[-1:], back[:-2]])
        behind[ends[:-1]] = back[-1]
        two, place = np.unique(pairs(tok, ends), return_inverse=True)
        seen = np.minimum(VALUE[self.grams.lookup(two)][place], np.minimum(q[at], q[behind]))  # a pair is no more frequent than its tokens
        rest = np.maximum(q - s, 0.0) + PRIOR
        return np.log10((seen + rest[behind] * self.unigram(q[at])) / (s[behind] + rest[behind]))


def fit(train: DataFrame, text_col: str = "text", *, head: int = HEAD, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model, and the exact counts ``(h, c)`` of all training tokens."""
    spark = train.sparkSession
    with Scope(spark) as scope:
        counts = scope.keep(scope.table(token_counts(train, text_col), "counts"))
        level = F.floor(F.log2("c")).cast("int") + 1
        sizes = counts.groupBy(level.alias("k")).agg(F.count("*"), F.sum("c")).collect()  # 62 rows at most
        n, v = sum(r[2] for r in sizes), sum(r[1] for r in sizes)
        quantised = float(sum(r[1] * VALUE[r[0]] for r in sizes))
        top = counts.orderBy(F.desc("c"), "h").limit(head).toArrow()
        top_h, top_c = (top.column(x).to_numpy() for x in ("h", "c"))
        order = np.argsort(top_h.view(np.uint64))
        two = scope.table(pair_counts(train, n, text_col, least=least), "pairs")
        totals = scope.table(two.where("kind = 1").groupBy("h").agg(F.sum("c").alias("s")).mapInArrow(_total_entries, "h long, c long"), "totals")
        entries = counts.select("h", "c").unionByName(two.where("kind = 0").select("h", "c")).unionByName(totals)
        grams = build_filter(entries)
    return Model(grams, top_h[order].view(np.uint64), top_c[order], int(n), int(v), quantised), counts


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = utf8(b.column(2))
            ids, held = b.column(0), b.column(1)
            for i, j in chunks([len(t or b"") for t in texts], CHUNK_BYTES):
                tok, ends = tokens(texts[i:j])
                starts = np.concatenate([[0], ends[:-1]])
                c, known = model.exact(tok)
                base = np.add.reduceat(np.where(known, model.base(c), 0.0), starts)
                score = np.add.reduceat(model.score(tok, ends), starts)
                doc = np.repeat(np.arange(j - i), ends - starts)
                r_doc, r_tok = doc[~known], tok[~known]
                order = np.lexsort((r_tok, r_doc))
                r_doc, r_tok = r_doc[order], r_tok[order]
                new = np.nonzero(np.append(True, (r_doc[1:] != r_doc[:-1]) | (r_tok[1:] != r_tok[:-1]))[: len(r_doc)])[0]
                rare, rare_n = r_tok[new], np.diff(np.append(new, len(r_doc)))
                cut = np.searchsorted(r_doc[new], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), held.slice(i, j - i), pa.array(ends - starts), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(rare.view(np.int64))), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(rare_n.astype(np.int32)))],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_score", "score", "rare", "rare_n"],
                )

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row; ``counts`` has the exact counts of all training tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, score double, rare array<long>, rare_n array<int>"
    part = materialize(d.mapInArrow(_scores(shared), kind).withColumn("row", F.monotonically_increasing_id()), "scored")  # the files fix the row numbers
    rare = part.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    base = F.log10((c + 0.5) / F.lit(model.n + 0.5 * (model.v + 1)))
    rare = rare.join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("n") * base).alias("rare_score"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    zero = F.lit(0)
    return part.drop("rare", "rare_n").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", zero)).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    training = crc_mod("doc_id", 5) != 1
    model, counts = fit(docs.where(training))
    return score(docs, model, counts, ~training)

