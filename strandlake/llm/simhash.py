"""SimHash near-duplicate grouping by generalised pigeonhole search.

A fingerprint has 64 bits; two fingerprints are linked when at most ``radius`` of them
differ, and documents are grouped by the connected components of those links.

1. Fingerprints are made in Python over whole texts and written once; equal fingerprints
   are one node from there on, so copies cost nothing more.
2. Bits are grouped by correlation, measured over all distinct fingerprints (a 64 x 64
   matrix, whatever the input).  Correlated bits share a group, which leaves the others
   close to independent.
3. The principle: if the thresholds t_g of the groups satisfy sum(t_g + 1) = radius + 1,
   any two linked fingerprints differ in at most t_g bits of some group g (t_g = -1 skips a
   group).  For 2, 3 and 4 groups, dynamic programming picks the thresholds with the least
   estimated cost, from the number of pairs that share a group's value in all data.
4. Probing: a fingerprint is put in the bucket of every value within t_g of its own.
   Buckets are compared in place and only links of a spanning forest leave them.
5. A bucket of over ``MAX_BLOCK`` distinct fingerprints isn't compared.  Its fingerprints
   go another exact way, linear in their number: x and y differ in at most 3 bits exactly
   if some value lies within 1 bit of one and 2 bits of the other.  All fingerprints within
   1 bit of a value are linked to each other (2 bits at most) and to all within 2 of it, so
   a star around the smallest of them stands for all the pairs.

Defined results: a null or empty text has fingerprint 0 and is linked like any other;
repeated rows give equal rows; rows with a null id are grouped too, and a group without
any id has a null component; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import documents, fresh, slices, utf8
from strandlake.operators.components import connected_components
from strandlake.plans.scratch import materialize

MAX_BLOCK = 1 << 15
SMALL = 32
ONE = 1 << 64
#: Cost of one signature row against one compared pair (measured: a shuffled row, a XOR).
SIGNATURE_COST, PAIR_COST = 200.0, 4.0
_LANES = np.uint64(0x0101010101010101)


def signed(x: int) -> int:
    return x - ONE if x >= ONE >> 1 else x


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the shingles of ``width`` words, as an unsigned integer."""
    words = (text or b"").lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    cuts = np.arange(0, n, 255)  # a lane of 8 bits holds 255 ones
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts)
        ones = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.nonzero(2 * ones > n)[0]:
            out |= 1 << (8 * int(lane) + k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [signed(fingerprint(t)) for t in utf8(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp as the signed form of the 64 bits."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_fingerprints, "doc_id long, fp long")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((65, 65))
    for b in batches:
        bits = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        x = np.concatenate([bits.astype(np.float32), np.ones((len(bits), 1), np.float32)], axis=1)
        total += x.T @ x
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i * 65 + j), pa.array(total[i, j].astype(np.int64))], ["cell", "n"])


def correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of the 64 bits over all fingerprints."""
    cells = fps.select("fp").mapInArrow(_moments, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    m = np.zeros(65 * 65)
    for cell, n in cells:  # 4225 at most
        m[cell] = n
    m = m.reshape(65, 65)
    n = max(m[64, 64], 1.0)
    mean = m[64, :64] / n
    cov = m[:64, :64] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(dev, dev))


def group_bits(corr: np.ndarray, groups: int) -> list[list[int]]:
    """``groups`` lists of bits of nearly equal length; each takes the most correlated that are left."""
    left, out = list(range(64)), []
    for g in range(groups):
        take = len(left) // (groups - g)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < take:
            nearest = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(nearest)
            left.remove(nearest)
        out.append(sorted(own))
    return out


def ball(width: int, radius: int) -> int:
    return sum(comb(width, i) for i in range(radius + 1))


def allocate(widths: list[int], pairs: list[float], n: float, radius: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t + 1) = radius + 1, by dynamic programming.

    ``pairs[g]`` counts ordered pairs that agree in group g; by Cauchy-Schwarz no more than
    ball(width, t) times as many lie within t of each other there.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for w, p in zip(widths, pairs):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for units in range(radius + 2 - used):
                t = units - 1
                own = ball(w, t) * (SIGNATURE_COST * n + PAIR_COST * p) if t >= 0 else 0.0
                if used + units not in new or cost + own < new[used + units][0]:
                    new[used + units] = (cost + own, [*ts, t])
        best = new
    return best[radius + 1]


def plan(fps: DataFrame, radius: int = 3) -> list[tuple[int, list[int]]]:
    """Groups with their thresholds: ``(mask, [xor of every probed value])``."""
    corr = correlation(fps)
    layouts = {m: group_bits(corr, m) for m in range(2, radius + 2)} or {1: [list(range(64))]}
    masks = {(m, g): sum(1 << b for b in bits) for m, groups in layouts.items() for g, bits in enumerate(groups)}
    order = sorted(masks)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(signed(masks[k]))).alias("v")) for i, k in enumerate(order)]))
    sizes = fps.select(each.alias("x")).groupBy("x.g", "x.v").count()
    stats = sizes.groupBy("g").agg(F.sum(F.col("count").cast("double") ** 2).alias("s2"), F.sum("count").alias("n")).collect()
    s2 = {order[r["g"]]: (r["s2"], r["n"]) for r in stats}  # a row for each group
    chosen = []
    for m, groups in layouts.items():
        n = max(s2.get((m, 0), (0.0, 0))[1], 1)  # a row to weigh even if there is none
        cost, ts = allocate([len(b) for b in groups], [s2.get((m, g), (0.0, 0))[0] - n for g in range(m)], n, radius)
        chosen.append((cost, m, ts))
    _, m, ts = min(chosen)
    out = []
    for g, (bits, t) in enumerate(zip(layouts[m], ts)):
        if t >= 0:
            flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)]
            out.append((masks[m, g], flips))
    return out


def _signatures(fps: DataFrame, groups: list[tuple[int, list[int]]]) -> DataFrame:
    out = []
    for g, (mask, flips) in enumerate(groups):
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        out.append(fps.select(F.lit(g).alias("g"), _flipped(own, flips).alias("v"), "fp"))
    return reduce(DataFrame.unionByName, out)


def _flipped(value: Column, flips: list[int]) -> Column:
    """The value with every one of the masks applied, a row each."""
    if flips == [0]:
        return value
    return F.explode(F.transform(F.lit(np.array([signed(x) for x in flips], np.int64)), lambda x: x.bitwiseXOR(value)))


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Breadth-first search: every fingerprint is compared with those not yet reached only."""
    left = fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue, reached = [root], []
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                reached.append(found)
        if reached:
            yield np.concatenate(reached), root


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(g, v, fp):
            out = []
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
            begin = np.nonzero(new)[0]
            size = np.diff(np.append(begin, len(g)))
            bucket = np.cumsum(new) - 1
            small = size[bucket] <= SMALL
            for d in range(1, min(SMALL, len(g))):
                same = small[:-d] & (bucket[:-d] == bucket[d:])
                if not same.any():
                    break
                i = np.nonzero(same)[0]
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
                out.append((fp[i], fp[i + d]))
            for k in np.nonzero(size > SMALL)[0]:
                for found, root in _forest(fp[begin[k] : begin[k] + size[k]], radius):
                    out.append((found, np.full(len(found), root, np.uint64)))
            if out:
                u, w = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["u", "v"])

        held = None
        for b in batches:
            now = [c.to_numpy() for c in b.columns]
            now[2] = now[2].view(np.uint64)  # the sign would disturb the bit count
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0]
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield from compare(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield from compare(*held)

    return run


def _dense_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links among the given fingerprints by shared values, without comparing pairs."""
    near, far = radius // 2, radius - radius // 2

    def around(r: int) -> DataFrame:
        flips = [sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(64), k)]
        return fps.select("fp", _flipped(F.col("fp"), flips).alias("at"))

    centre = around(near).groupBy("at").agg(F.min("fp").alias("v"))
    return around(far).join(centre, "at").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def link(fps: DataFrame, radius: int = 3, *, max_block: int = MAX_BLOCK) -> DataFrame:
    """Edges ``(u, v)`` over distinct fingerprints with the components of all links."""
    sig = _signatures(fps, plan(fps, radius))
    hot = materialize(sig.groupBy("g", "v").count().where(F.col("count") > max_block).select("g", "v"), "hot")
    if hot.isEmpty():
        dense = None
    else:
        dense = materialize(sig.join(hot, ["g", "v"], "left_semi").select("fp").distinct(), "dense")
        sig = sig.join(hot, ["g", "v"], "left_anti")
    sorted_ = sig.select("g", "v", "fp").repartition("g", "v").sortWithinPartitions("g", "v")
    edges = sorted_.mapInArrow(_links(radius), "u long, v long")
    return edges if dense is None else edges.unionByName(_dense_links(dense, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 3, max_block: int = MAX_BLOCK) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comps = connected_components(link(nodes.select("fp"), radius, max_block=max_block))
    named = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "comp").join(least, "comp").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 3) -> DataFrame:
    """``docs`` without near duplicates: of every group the row with the least (id, text hash) stays.

    Rows that are equal in both are one document of which one row stays; an empty group key
    (a null id) sorts last.
    """
    cols = docs.columns
    th, first_id, first_h = fresh(cols, "_th", "_id", "_h")
    d = docs.withColumn(th, F.xxhash64(F.col(text_col).cast("string")))
    prints = materialize(_keyed_prints(d.select(F.col(id_col).cast("long").alias("_id"), F.col(th).alias("_th"), F.col(text_col).cast("string").alias("text"))), "prints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_th")).alias("first"))
    nodes = materialize(nodes, "nodes")
    comps = connected_components(link(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    first = named.groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first._id").alias(first_id), F.col("first._th").alias(first_h))
    # one row per group comes back to the texts, by id and text hash
    kept = d.join(first, F.col(id_col).cast("long").eqNullSafe(F.col(first_id)) & F.col(th).eqNullSafe(F.col(first_h)), "left_semi")
    return kept.dropDuplicates([id_col, th]).select(*cols)


def _keyed_prints(d: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            prints = [signed(fingerprint(t)) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], ["_id", "_th", "fp"])

    return d.mapInArrow(run, "_id long, _th long, fp long")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of every near-duplicate group stays."""
    return keep_first(docs)
