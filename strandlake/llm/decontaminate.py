"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in a normal form: lower case, runs of white space as one blank.  Every
benchmark item is covered by overlapping segments of ``SEGMENT`` characters; a document leaks
an item if it holds a segment with at most one edit for every ``EDIT_SPAN`` characters.

Filter: if a text holds a segment of n characters with at most e edits, the two share at
least n - q + 1 - q * e q-grams, and the diagonals (place in the text minus place in the
segment) of those lie within e of each other.  Diagonals are cut into bands of 2 (e + 1) that
overlap by half, so one band has all of them; shared q-grams are counted by band, and a band
below the bound is done with.  Verification: the segment is aligned with the text around the
band, within the band's diagonals, and the least number of edits is taken.

Only the benchmark's index is broadcast.  Items are taken in blocks of at most
``MAX_BLOCK_CHARS`` characters (or of one item), one pass over the documents for each, so that the index
has a size bound whatever the benchmark's; the documents are never shuffled.  Equal segments of
all items are one, and places that share a q-gram are counted in parts of ``MAX_SHARED``, so that
a q-gram that is frequent in text and item alike takes time but no memory.

A passage of an item is found for certain if it is verbatim and has SEGMENT + STRIDE - 1 (119)
characters of the normal form, or is a whole item of ``MIN_CHARS`` (30) to 80.  Items of 12 (Q) to 29
characters are looked for whole, without edits and as whole words; shorter ones are no evidence.

Defined results: a null or empty text leaks nothing; null items and items whose normal form
is under Q characters are skipped; repeated items are
reported each by its own id, repeated documents each by its own row; other columns pass, whatever
their names, and ``leaks`` takes the place of an input column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import chunks, documents, fresh, slices, with_text, without

Q, SEGMENT, STRIDE, EDIT_SPAN, MIN_CHARS = 12, 80, 40, 16, 30
MAX_BLOCK_CHARS, MAX_BLOCKS = 4_000_000, 1 << 20
CHUNK_CHARS = 1 << 19
#: Shared places that are looked at at once (of one place in the text, all at least).
MAX_SHARED = 1 << 20
FILTER_BITS = 22
LEAK = "array<struct<item_id:bigint,begin:bigint,end:bigint,edits:int>>"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edits_allowed(n: int) -> int:
    """The edit budget of a segment: one for EDIT_SPAN characters, if the lemma's bound stays positive."""
    return max(0, min(n // EDIT_SPAN, (n - Q) // Q))


def qgrams(code: np.ndarray) -> np.ndarray:
    """Hashes of all windows of Q code points."""
    h1 = (code.astype(np.uint64) + np.uint64(1)) * _MUL
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint64(29))) * _MUL + h1[1:]
    h4 = (h2[:-2] ^ (h2[:-2] >> np.uint64(29))) * _MUL + h2[2:]
    h8 = (h4[:-4] ^ (h4[:-4] >> np.uint64(29))) * _MUL + h4[4:]
    return (h8[:-4] ^ (h8[:-4] >> np.uint64(29))) * _MUL + h4[8:]


def align(segment: str, window: str, low: int, high: int) -> tuple[int, int]:
    """Least edits of ``segment`` in ``window`` and where that ends, on diagonals low to high.

    A diagonal is place in the window minus place in the segment; both ends of the window are free.
    """
    at = window.find(segment)
    if at >= 0:
        return 0, at + len(segment)
    width, far = high - low + 1, 10**6
    text = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32)
    step = np.arange(width)
    place = low + step  # of the window, before row 0
    row = np.where((place >= 0) & (place <= len(text)), 0, far)
    for i, c in enumerate(segment.encode("utf-32-le", "surrogatepass")[k : k + 4] for k in range(0, 4 * len(segment), 4)):
        letter = int.from_bytes(c, "little")
        place = low + step + i  # the window's character that a diagonal step takes
        ok = (place >= 0) & (place < len(text))
        same = np.zeros(width, bool)
        same[ok] = text[place[ok]] == letter
        new = np.where(ok, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the segment alone
        end = place + 1
        new = np.where((end >= 0) & (end <= len(text)), new, far)
        new = np.minimum.accumulate(new - step) + step  # characters of the window alone
        row = new
    best = int(row.argmin())
    return int(row[best]), low + best + len(segment)


class Index:
    """Segments of a block of items with the places of their q-grams; equal segments are one."""

    def __init__(self, items: list[tuple[int, str]]):
        owners: dict[str, dict[int, None]] = {}
        whole: set[str] = set()
        for item, text in items:
            t = normal(text)
            if len(t) < Q:
                continue
            starts = list(range(0, max(1, len(t) - SEGMENT + 1), STRIDE))
            if starts[-1] + SEGMENT < len(t):
                starts.append(len(t) - SEGMENT)
            for s in starts:
                owners.setdefault(t[s : s + SEGMENT], {})[item] = None
            if len(t) < MIN_CHARS:
                whole.add(t)
        self.segments, self.owners = list(owners), [list(x) for x in owners.values()]
        self.whole = np.array([s in whole for s in self.segments], bool)
        self.edits = np.array([0 if w else edits_allowed(len(s)) for s, w in zip(self.segments, self.whole)], np.int64)
        self.need = np.array([len(s) - Q + 1 for s in self.segments], np.int64) - Q * self.edits
        per = [qgrams(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)) for s in self.segments]
        sizes = [len(p) for p in per]
        h = np.concatenate(per) if per else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(per)), sizes)
        pos = np.concatenate([np.arange(n) for n in sizes]) if per else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.seg, self.pos = h[order], seg[order], pos[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = []
        for i, j in chunks([len(t or "") for t in texts], CHUNK_CHARS):
            out += self._leaks([normal(t) for t in texts[i:j]])
        return out

    def _leaks(self, texts: list[str]) -> list[list[dict]]:
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        joined = "\n".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(code) < Q or not self.segments:
            return [[] for _ in texts]
        h = qgrams(code)
        at = np.nonzero(self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
        left, right = np.searchsorted(self.h, h[at]), np.searchsorted(self.h, h[at], "right")
        n = right - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        # a q-gram that is frequent on both sides makes many shared places: they are counted in parts of bounded size
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in chunks(n.tolist(), MAX_SHARED):
            parts.append(self._shared(starts, at[a:b], left[a:b], n[a:b]))
            if len(parts) > 8:
                parts = [_counted(*map(np.concatenate, zip(*parts)))]
        if parts:
            for d, s, band in self._cells(*_counted(*map(np.concatenate, zip(*parts))), int(starts[-1])):
                self._verify(texts[d], int(starts[d]), s, band, found[d])
        return [[{"item_id": k, "begin": v[1], "end": v[2], "edits": v[0]} for k, v in sorted(f.items())] for f in found]

    def _shared(self, starts: np.ndarray, at: np.ndarray, left: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of shared q-grams by text, segment and band, as one key."""
        where = np.repeat(at, n)
        cell = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        seg, diagonal = self.seg[cell], where - self.pos[cell]
        doc = np.searchsorted(starts, where, "right") - 1
        key = (doc * len(self.segments) + seg) * (int(starts[-1]) + 2 * SEGMENT) + diagonal // (self.edits[seg] + 1) + SEGMENT
        return _counted(np.concatenate([key, key - 1]), None)

    def _cells(self, key: np.ndarray, shared: np.ndarray, chars: int) -> list[tuple[int, int, int]]:
        """Text, segment and band wherever the bound is met."""
        wide = chars + 2 * SEGMENT
        seg = key // wide % len(self.segments)
        on = shared >= self.need[seg]
        key, seg = key[on], seg[on]
        return list(zip((key // wide // len(self.segments)).tolist(), seg.tolist(), (key % wide - SEGMENT).tolist()))

    def _verify(self, text: str, start: int, s: int, band: int, found: dict) -> None:
        segment, e = self.segments[s], int(self.edits[s])
        low = band * (e + 1) - start
        begin = max(0, low - e)
        stop = min(len(text), low + 2 * (e + 1) + len(segment) + e)
        edits, end = align(segment, text[begin:stop], low - e - begin, low + 2 * (e + 1) - 1 + e - begin)
        if edits <= e:
            end += begin
            first = max(0, end - len(segment))
            if self.whole[s] and (text[first - 1 : first].strip() or text[end : end + 1].strip()):
                return  # a short item counts as words of their own only
            for item in self.owners[s]:
                old = found.get(item)
                found[item] = (edits, first, end) if old is None else (min(old[0], edits), min(old[1], first), max(old[2], end))


def _counted(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with their sums."""
    if n is None:
        return np.unique(key, return_counts=True)
    own, back = np.unique(key, return_inverse=True)
    return own, np.bincount(back, n, minlength=len(own)).astype(np.int64)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_chars: int) -> Iterator[Index]:
    """Indexes of blocks of distinct items, of at most ``max_chars`` characters or one item each."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and item_id is not null").distinct()
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block")
        sizes = items.groupBy(block).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("items")).where((F.col("items") > 1) & (F.col("chars") > max_chars))
        if n >= MAX_BLOCKS or sizes.isEmpty():
            break
        n *= 2
    for k in range(n):
        own = items.where(block.eqNullSafe(k)) if n > 1 else items
        yield Index(sorted(map(tuple, own.collect())))


def mark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``leaks``: for every item found in it, its id, the part of the normal form, least edits."""
    cols = without(docs.columns, "leaks")
    d, at = with_text(docs, text_col)
    extra = d.columns[len(docs.columns) :]  # a cast copy of the text, if that is no string
    (leaks,) = fresh(d.columns, "_leaks")
    out = d.withColumn(leaks, F.array().cast(LEAK))
    schema = out.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    for index in _blocks(benchmark, item_id, item_text, max_block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, at):
                new = shared.value.leaks(b.column(at).to_pylist())
                both = pa.array([x + y for x, y in zip(b.column(len(b.columns) - 1).to_pylist(), new)], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], both], names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return out.drop(*extra).select(*[F.col(f"`{c}`") for c in cols], F.col(leaks).alias("leaks"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of document and benchmark item that it leaks."""
    marked = mark(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", F.col("x.begin").alias("begin_at"), F.col("x.end").alias("end_at"), F.col("x.edits").alias("edits"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go."""
    own = [c for c in docs.columns if c.lower() == "leaks"]
    moved = dict(zip(own, fresh(docs.columns, *[f"_{c}" for c in own])))
    marked = mark(docs.withColumnsRenamed(moved), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).drop("leaks").withColumnsRenamed({b: a for a, b in moved.items()}).select(*docs.columns)
