"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A folder holds, for every part ``p`` of a range partitioning by document id,

``ids-p.u16`` or ``.u32``   the ids of its documents, one after the other, little-endian
``offsets-p.u64``           where each document begins in that file, and the end (n + 1 values)
``docs-p.i64``              the document ids, ascending; rows without an id come first

and ``manifest.json``: width, end id and, for every part, its documents, null ids, tokens and
base.  A base is the number of ids in all parts before it: a prefix sum over the parts'
totals, so that no task has to wait for another.  The folder must be on a file system that
all executors mount (``file:``), since files are memory-mapped.  A task writes under a name of
its own and renames at the end: a task that runs again after a lost executor replaces whole
files by equal ones.

Encoding keeps, in every Python worker, the ids of text pieces between ASCII blanks that it
has seen.  Normalisation and splitting of the tokenizer never reach over white space, so that
the ids of a text are those of its pieces in order (the tests compare with the library on
whole texts); texts with the string of a special token go through the library whole.

Defined results: a null or empty text has the end id alone; repeated rows are written again;
equal ids are ordered by a hash of their text; an empty table makes an empty folder with a
manifest.  Further columns are ignored.  Rows equal in both id and text stay in one part,
which is sorted with spilling and streamed.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import documents, utf8
from strandlake.plans.scratch import scratch_path

END_ID = 1
MAX_CACHED = 1_000_000
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class Encoder:
    """Ids of whole texts, from a bounded cache of pieces between blanks."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        if sys.byteorder != "little":
            raise RuntimeError("files are little-endian and written as they are in memory")
        spec = json.loads(self.tokenizer.to_str())
        # lower-casing an ASCII piece first changes nothing where the tokenizer lower-cases itself
        self.lower = '"Lowercase"' in json.dumps(spec.get("normalizer"))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of every text, as packed little-endian integers without the end id."""
        split: list = []
        if len(self.cache) > MAX_CACHED:
            # frequent pieces come early, so the older half is the one to keep
            self.cache = dict(islice(self.cache.items(), MAX_CACHED // 2))
        cache = self.cache
        for t in texts:
            t = t or b""
            low = t.lower()
            if any(s in low for s in self.special):
                split.append(t.decode())
            elif self.lower and b"\xcc" not in t and b"\xcd" not in t:  # no mark (U+0300 to U+037F) to compose with a letter
                split.append(low.split())
            else:
                split.append(t.split())
        missing = list(set().union(*(x for x in split if isinstance(x, list))).difference(cache))
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)):
                cache[p] = array(self.code, e.ids).tobytes()
        return [self._whole(x) if isinstance(x, str) else b"".join(map(cache.__getitem__, x)) for x in split]


def local_path(uri: str) -> str:
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {uri}")
    return found.path


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        context = TaskContext.get()
        part, mark = context.partitionId(), f".{context.taskAttemptId()}.tmp"
        names = [f"{folder}/{n}" for n in (f"ids-{part:06d}.u{32 if encoder.wide else 16}", f"offsets-{part:06d}.u64", f"docs-{part:06d}.i64")]
        end = np.array([end_id], encoder.dtype).tobytes()
        n_docs = n_null = n_tokens = 0
        with open(names[0] + mark, "wb") as ids, open(names[1] + mark, "wb") as offsets, open(names[2] + mark, "wb") as docs:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    rows = b.slice(at, 512)
                    packed = encoder.encode(utf8(rows.column(1)))
                    sizes = np.array([len(x) for x in packed], np.uint64) // encoder.dtype.itemsize + np.uint64(1)
                    ends = n_tokens + np.cumsum(sizes, dtype=np.uint64)
                    offsets.write((ends - sizes).astype("<u8").tobytes())
                    docs.write(rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    ids.write(end.join(packed) + end)
                    n_docs, n_null, n_tokens = n_docs + rows.num_rows, n_null + rows.column(0).null_count, int(ends[-1])
            offsets.write(np.array([n_tokens], "<u8").tobytes())
        for name in names:
            os.replace(name + mark, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "nulls": [n_null], "tokens": [n_tokens]})

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> dict:
    """Write the folder and return its manifest, which has an entry per part."""
    spark = docs.sparkSession
    where = local_path(folder)
    os.makedirs(where, exist_ok=True)
    encoder = Encoder.of(tokenizer)
    top = (1 << (32 if encoder.wide else 16)) - 1
    if not 0 <= end_id <= top:
        raise ValueError(f"end id {end_id} does not fit the files' integers")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("_h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h").asc()]
    d = d.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = sorted(map(tuple, d.mapInArrow(_write(where, tokenizer, end_id), "part long, docs long, nulls long, tokens long").collect()))
    base, entries = 0, []
    for part, n_docs, nulls, tokens in found:
        entries.append({"part": part, "docs": n_docs, "nulls": nulls, "tokens": tokens, "base": base})
        base += tokens
    manifest = {"format": 1, "width": 32 if encoder.wide else 16, "end_id": end_id, "tokens": base, "parts": entries}
    with open(f"{where}/manifest.tmp", "w") as f:
        json.dump(manifest, f)
    os.replace(f"{where}/manifest.tmp", f"{where}/manifest.json")
    return manifest


def read_part(folder: str, width: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory-mapped ids, offsets and document ids of a part."""

    def mapped(name: str, dtype: str) -> np.ndarray:
        path = f"{folder}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)

    return mapped(f"ids-{part:06d}.u{width}", f"<u{width // 8}"), mapped(f"offsets-{part:06d}.u64", "<u8"), mapped(f"docs-{part:06d}.i64", "<i8")


def _read(folder: str, width: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, nulls, base in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids, offsets, docs = read_part(folder, width, part)
                for at in range(0, len(docs), 1024):
                    own = docs[at : at + 1024]
                    cuts = offsets[at : at + len(own) + 1].astype(np.int64)
                    wide = np.asarray(ids[cuts[0] : cuts[-1]]).astype("<u4")
                    local = cuts - cuts[0]
                    crc = [zlib.crc32(wide[i:j].data) for i, j in zip(local[:-1], local[1:])]
                    cols = [pa.array(own, mask=np.arange(at, at + len(own)) < nulls), pa.array(cuts[:-1] + base), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(local, pa.int32()), pa.array(wide.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: id, start, number of ids, their crc32 and, if asked for, the ids."""
    where = local_path(folder)
    with open(f"{where}/manifest.json") as f:
        manifest = json.load(f)
    rows = [(e["part"], e["nulls"], e["base"]) for e in manifest["parts"] if e["docs"]]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    parts = spark.createDataFrame(rows, "part long, nulls long, base long")
    return parts.repartition(max(1, len(rows)), "part").mapInArrow(_read(where, manifest["width"], with_ids), schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), folder, default_tokenizer())
    return read_tokens(spark, folder)
