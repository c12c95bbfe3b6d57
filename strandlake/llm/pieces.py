"""Sampled SentencePiece encoding without replacement, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a place, and
byte pieces for a character that has no piece of its own.  A piece of rank r weighs 1 / (1 + r),
so that a segmentation has the probability of the product of its pieces' weights, normed over
the lattice.  The text as the tokenizer sees it starts with one extra blank.

Search: the k segmentations with the largest Gumbel-perturbed log-probabilities are a sample
of size k without replacement.  They are found best first.  A queue holds regions of the
lattice (sets of segmentations that share a beginning); a region's priority is its largest
perturbed value, drawn at once from a Gumbel distribution placed at the region's log-mass and
truncated at its parent's value.  Masses are exact, from backward sums over the lattice, so the
bound is tight and every region that is taken from the queue gives one segmentation; what
is left of it goes back as two regions.  The last value in the queue after k results is the
threshold kappa of their inclusion scores, log(1 - exp(-exp(log p - kappa))).

No piece of such a vocabulary holds a blank after another character, or a line feed, and most
hold no punctuation beside letters: where no piece holds two neighbouring characters the text
is cut, and its lattice is a chain of its words' lattices.  Those of words that a worker has seen
are kept, up to ``MAX_WORDS``, and all words of many texts are walked at once with numpy.
Random numbers are a hash of (seed, row key, sample, place): they don't depend on partitions or
attempts, so a repeated task returns the same rows.

Defined results: a null text counts as empty; an empty text has one segmentation, the extra
blank.  A text with fewer than k segmentations returns all of them, with inclusion 1
(log 0).  Equal rows get equal results, a null key counts as the empty text; other columns
pass through.  Decoding returns exactly the text that was encoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, expm1, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import chunks, documents, fresh, release, slices, with_text, without

K = 2
SEED = 20240601
MAX_WORDS = 120_000
CHUNK_CHARS = 1 << 18
#: Pairs of characters below this code are looked up in a table.
SMALL = 0x180
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_I1, _I2, _IGOLD, _ALL = int(_M1), int(_M2), int(_GOLD), (1 << 64) - 1
SAMPLES = "array<struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on both keys only."""
    x = key + at * _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def truncated_gumbel(place: float, bound: float, u: float) -> float:
    """A Gumbel value placed at ``place``, given that it is below ``bound``."""
    return place - log(exp(min(place - bound, 700.0)) - log(u))


def log_inclusion(log_prob: float, kappa: float) -> float:
    """log of 1 - exp(-exp(log_prob - kappa)), without underflow."""
    x = log_prob - kappa
    if x > 3.5:
        return 0.0 if x > 7 else log1p(-exp(-exp(x)))
    return x if x < -30 else log(-expm1(-exp(x)))


def _put(held: np.ndarray, n: int, new: np.ndarray, rest: float = 0) -> np.ndarray:
    """``held`` with ``new`` after its first ``n`` values; a longer array, with ``rest`` at its end, if that has no room."""
    if n + len(new) > len(held):
        longer = np.full(max(n + n // 2, n + len(new)), rest, held.dtype)
        longer[:n] = held[:n]
        held = longer
    held[n : n + len(new)] = new
    return held


class Lattices:
    """Lattices of words in flat arrays: nodes in order, each with a run of edges."""

    _own: dict[str, Lattices] = {}

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece_bytes: list[bytes] = []
        self.vocab: dict[str, tuple[int, float]] = {}
        self.byte_id: dict[int, int] = {}
        rank = 0
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.piece_bytes.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.piece_bytes.append(b"")
            else:
                text = p.replace("▁", " ")
                if " " in text.lstrip(" ") or "\n" in text:
                    raise ValueError(f"piece {p!r} reaches over words")
                self.vocab[text] = (i, -log(1.0 + rank))
                self.piece_bytes.append(text.encode())
                rank += 1
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_weight = -log(1.0 + rank)
        #: The bytes of all pieces, one after the other, where each begins and how many it has.
        self.flat = np.frombuffer(b"".join(self.piece_bytes), np.uint8)
        self.flat_n = np.array([len(p) for p in self.piece_bytes], np.int64)
        self.flat_at = np.cumsum(self.flat_n) - self.flat_n
        self.prefixes = {t[:j] for t in self.vocab for j in range(1, len(t) + 1)}
        self.joined = np.zeros((SMALL, SMALL), bool)
        for t in self.vocab:
            for a, b in zip(t, t[1:]):
                if a < chr(SMALL) and b < chr(SMALL):
                    self.joined[ord(a), ord(b)] = True
        self._tables()
        self.clear()

    @classmethod
    def of(cls, path: str) -> Lattices:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def clear(self) -> None:
        self.word: dict[str, int] = {}
        self.nodes = self.n_edges = self.n_pieces = 0  # the arrays have room for more
        self.first = np.zeros(0, np.int32)  # of nodes: their first edge
        #: of edges: end of its share (node number + cumulated probability), node it leads to (-1: end),
        #: log-probability, mass of the node's other edges, and its pieces as a run of ``ids``.
        self.cdf, self.next, self.logp, self.other = np.zeros(0), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
        self.run, self.n_ids, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0, np.int32)

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all texts, each with its extra blank in front, and how many each text has.

        A text is cut wherever no piece holds the two characters in a row, so that no edge of the
        lattice reaches over a cut.
        """
        whole = "".join([f" {t}" for t in texts])
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.where(code < SMALL, code, 0)
        far = code >= SMALL
        on = self.joined[small[:-1], small[1:]] | far[:-1] | far[1:]
        on &= ~(((code[1:] == 32) & (code[:-1] != 32)) | (code[1:] == 10) | (code[:-1] == 10))
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        on[begin[1:-1] - 1] = False
        at = np.concatenate([[0], np.nonzero(~on)[0] + 1, [len(code)]])
        cut = at.tolist()
        return [whole[a:b] for a, b in zip(cut, cut[1:])], np.diff(np.searchsorted(at, begin))

    def edges(self, w: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every place of the word its edges: (place reached, log-weight, pieces)."""
        out = []
        for i in range(len(w)):
            own = []
            for j in range(i + 1, len(w) + 1):
                s = w[i:j]
                if s not in self.prefixes:
                    break
                found = self.vocab.get(s)
                if found:
                    own.append((j, found[1], (found[0],)))
            if w[i] not in self.vocab:
                raw = w[i].encode("utf-8", "surrogatepass")
                own.insert(0, (i + 1, self.byte_weight * len(raw), tuple(self.byte_id[b] for b in raw)))
            out.append(own)
        return out

    def _tables(self) -> None:
        """By length, the hashes of all beginnings of pieces, in order, with the piece that each is, if any."""
        texts = sorted(self.prefixes, key=len)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, len(texts[-1]) + 1):
            own = [t for t in texts if len(t) == n]
            code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * _M1 + code[:, k] + np.uint64(1)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
            piece = np.array([self.vocab.get(t, (-1, 0.0))[0] for t in own])[order]
            weight = np.array([self.vocab.get(t, (-1, 0.0))[1] for t in own])[order]
            self.by_length.append((h[order], code[order], piece, weight))

    def matches(self, code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces at all places: place, length, piece and log-weight; ``end`` is the end of each place's word."""
        out = []
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        for n, (hashes, codes, piece, weight) in enumerate(self.by_length, 1):
            on = at + n <= end[at]
            at = at[on]
            h = h[on] * _M1 + code[at + n - 1] + np.uint64(1)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            on = hashes[k] == h
            at, h, k = at[on], h[on], k[on]
            if not len(at):
                break
            on = piece[k] >= 0
            hit, k = at[on], k[on]
            same = (code[hit[:, None] + np.arange(n)] == codes[k]).all(axis=1)
            out.append((hit[same], np.full(int(same.sum()), n), piece[k[same]], weight[k[same]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)

    def add(self, words: list[str]) -> None:
        """Put the words' lattices into the arrays, all at once."""
        whole = "".join(words)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size) - size
        end = np.repeat(begin + size, size)
        at, n, piece, weight = self.matches(code, end)
        lacking = np.ones(len(code), bool)
        lacking[at[n == 1]] = False
        raw = [whole[i].encode("utf-8", "surrogatepass") for i in np.nonzero(lacking)[0].tolist()]
        at = np.append(at, np.nonzero(lacking)[0])
        n = np.append(n, np.ones(len(raw), np.int64))
        piece = np.append(piece, -1 - np.arange(len(raw)))  # a run of byte pieces
        weight = np.append(weight, [self.byte_weight * len(r) for r in raw])
        # backward sums, all words at once, by the distance to the word's end
        left = end[at] - at
        order = np.lexsort((n, at, left))
        at, n, piece, weight, left = (x[order] for x in (at, n, piece, weight, left))
        back = np.zeros(len(code) + 1)
        cuts = np.nonzero(np.append(True, left[1:] != left[:-1]))[0].tolist() + [len(left)]
        for a, b in zip(cuts, cuts[1:]):
            v = weight[a:b] + np.where(n[a:b] == left[a:b], 0.0, back[at[a:b] + n[a:b]])
            first = np.nonzero(np.append(True, at[a + 1 : b] != at[a : b - 1]))[0]
            back[at[a:b][first]] = np.logaddexp.reduceat(v, first)
        order = np.lexsort((n, at))
        at, n, piece, weight, left = (x[order] for x in (at, n, piece, weight, left))
        last = n == left
        logp = weight + np.where(last, 0.0, back[np.minimum(at + n, len(code))]) - back[at]
        p = np.exp(logp)
        first = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
        total = np.add.reduceat(p, first)
        per = np.diff(np.append(first, len(at)))
        run = np.cumsum(p)
        share = (run - np.repeat(run[first] - p[first], per)) / np.repeat(total, per)
        share = np.clip(share, 1e-12, 1 - 1e-12)
        share[np.append(first[1:], len(at)) - 1] = 1.0
        n_ids = np.ones(len(at), np.int64)
        bytes_at = np.nonzero(piece < 0)[0]
        runs = [raw[k] for k in (-1 - piece[bytes_at]).tolist()]
        n_ids[bytes_at] = [len(r) for r in runs]
        where = np.cumsum(n_ids) - n_ids
        ids = np.zeros(int(n_ids.sum()), np.int32)
        ids[where[piece >= 0]] = piece[piece >= 0]
        for k, r in zip(where[bytes_at].tolist(), runs):
            ids[k : k + len(r)] = [self.byte_id[b] for b in r]
        self.word.update(zip(words, (begin + self.nodes).tolist()))
        self.first = _put(self.first, self.nodes, first + self.n_edges)
        k = self.n_edges
        self.cdf = _put(self.cdf, k, self.nodes + at + share, np.inf)  # in order to the end
        self.next = _put(self.next, k, np.where(last, -1, self.nodes + at + n))
        self.logp, self.other = _put(self.logp, k, logp), _put(self.other, k, np.repeat(total, per) - p)
        self.run, self.n_ids = _put(self.run, k, where + self.n_pieces), _put(self.n_ids, k, n_ids)
        self.ids = _put(self.ids, self.n_pieces, ids)
        self.n_edges += len(at)
        self.n_pieces += len(ids)
        self.nodes += len(code)

    def starts(self, words: list[str]) -> np.ndarray:
        """First nodes of the words; new ones are added."""
        new = [w for w in dict.fromkeys(words) if w not in self.word]
        if new and len(self.word) + len(new) > MAX_WORDS:
            self.clear()
            new = list(dict.fromkeys(words))
        if new:
            self.add(new)
        return np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))

    def walk(self, start: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from every start to the end of its word: edges in order, and the start of each."""
        who, node, step = np.arange(len(start)), start, 0
        owners, taken = [], []
        while len(who):
            u = uniform(key[who], (place[who] << np.uint64(20)) + np.uint64(step))
            e, aim = self.first[node].astype(np.int64), node + u
            short = np.nonzero(self.cdf[e] <= aim)[0]
            while len(short):  # a node has few edges
                e[short] += 1
                short = short[self.cdf[e[short]] <= aim[short]]
            owners.append(who)
            taken.append(e)
            node = self.next[e]
            on = node >= 0
            who, node, step = who[on], node[on], step + 1
        owner, edge = np.concatenate(owners), np.concatenate(taken)
        order = np.argsort(owner, kind="stable")
        return edge[order], owner[order]

    def pieces(self, edges: np.ndarray) -> np.ndarray:
        n = self.n_ids[edges].astype(np.int64)
        if n.max(initial=1) == 1:
            return self.ids[self.run[edges]]
        first = np.cumsum(n) - n
        return self.ids[np.repeat(self.run[edges] - first, n) + np.arange(n.sum())]

    def node_edges(self, edge: int) -> tuple[int, int]:
        """The run of edges that leave the same node."""
        node = int(np.ceil(self.cdf[edge])) - 1
        return int(self.first[node]), int(self.first[node + 1]) if node + 1 < self.nodes else self.n_edges


class _Text:
    """Sampling for one text: ``walks[s]`` is an independent path, as edges and their words."""

    def __init__(self, lat: Lattices, key: int, walks: list[tuple[np.ndarray, np.ndarray]]):
        self.lat, self.key, self.walks, self.draws = lat, key, walks, 0

    def u(self) -> float:
        self.draws += 1
        x = ((self.key ^ _I1) + self.draws * _IGOLD) & _ALL  # uniform() for one number
        x = ((x ^ (x >> 30)) * _I1) & _ALL
        x = ((x ^ (x >> 27)) * _I2) & _ALL
        return (((x ^ (x >> 31)) >> 12) + 0.5) / (1 << 52)

    def group(self, edges, words, first: int, barred: frozenset, bound: float):
        """The region of all that leave the path at edge ``first`` or later, with its largest value."""
        lat = self.lat
        logp, other = lat.logp[edges], lat.other[edges].copy()
        if barred:
            lo, hi = lat.node_edges(int(edges[first]))
            other[first] = sum(exp(lat.logp[e]) for e in range(lo, hi) if e not in barred and e != edges[first])
        before = np.cumsum(logp) - logp
        mass = np.exp(before) * other
        mass[:first] = 0.0
        return self.region(edges, words, mass, first, barred, bound)

    def region(self, edges, words, mass, first, barred, bound):
        total = float(mass.sum())
        if total <= 0:
            return None
        return truncated_gumbel(log(total), bound, self.u()), edges, words, mass, first, barred

    def samples(self, k: int) -> tuple[list[tuple[np.ndarray, float, float]], float | None]:
        """Up to k results (edges, log-probability, perturbed value), and the threshold after them."""
        lat = self.lat
        edges, words = self.walks[0]
        top = -log(-log(self.u()))
        out = [(edges, float(lat.logp[edges].sum()), top)]
        queue = [r for r in [self.group(edges, words, 0, frozenset(), top)] if r]
        while queue and len(out) < k:
            best = max(range(len(queue)), key=lambda i: queue[i][0])
            value, edges, words, mass, first, barred = queue.pop(best)
            i = min(int(np.searchsorted(np.cumsum(mass), self.u() * mass.sum(), "right")), len(mass) - 1)
            while mass[i] <= 0:  # rounding at the last place
                i -= 1
            out_here = barred | {int(edges[i])} if i == first else frozenset({int(edges[i])})
            lo, hi = lat.node_edges(int(edges[i]))
            free = [e for e in range(lo, hi) if e not in out_here]
            p = np.cumsum([exp(lat.logp[e]) for e in free])
            chosen = [free[min(int(np.searchsorted(p, self.u() * p[-1], "right")), len(free) - 1)]]
            while lat.next[chosen[-1]] >= 0:  # to the end of the word
                node = float(lat.next[chosen[-1]])
                chosen.append(int(np.searchsorted(lat.cdf, node + self.u(), "right")))
            fresh, fresh_words = self.walks[len(out)]
            cut = int(np.searchsorted(fresh_words, words[i], "right"))
            new = np.concatenate([edges[:i], chosen, fresh[cut:]]).astype(np.int64)
            new_words = np.concatenate([words[:i], np.full(len(chosen), words[i]), fresh_words[cut:]])
            out.append((new, float(lat.logp[new].sum()), value))
            left = mass.copy()
            left[i] = 0.0
            queue += [r for r in (self.region(edges, words, left, first, barred, value), self.group(new, new_words, i, out_here, value)) if r]
        return out, max((r[0] for r in queue), default=None)


def encode_texts(lat: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[dict]]:
    """Samples of every text, the largest perturbed value first; all words of the texts are walked at once."""
    words, sizes = lat.split(texts)
    start = lat.starts(words)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = (np.arange(len(start)) - (ends - sizes)[doc]).astype(np.uint64)
    walks = []
    for s in range(k):
        edge, word = lat.walk(start, keys[doc] ^ np.uint64((s + 1) * int(_M2) & 0xFFFFFFFFFFFFFFFF), place)
        walks.append((edge, word, np.concatenate([[0], np.searchsorted(word, ends, "left")])))
    out = []
    for d in range(len(texts)):
        own = [(e[c[d] : c[d + 1]], w[c[d] : c[d + 1]]) for e, w, c in walks]
        found, kappa = _Text(lat, int(keys[d]), own).samples(k)
        out.append([{"ids": lat.pieces(e), "log_prob": lp, "perturbed": g, "log_inclusion": 0.0 if kappa is None else log_inclusion(lp, kappa)} for e, lp, g in found])
    return out


def decode_ids(lat: Lattices, ids) -> bytes:
    """The UTF-8 text of the pieces, without the extra blank."""
    return b"".join([lat.piece_bytes[i] for i in ids])[1:]


def decode_array(lat: Lattices, ids: np.ndarray) -> bytes:
    """``decode_ids`` of an array."""
    n = lat.flat_n[ids]
    return lat.flat[np.repeat(lat.flat_at[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()[1:]


def row_keys(values: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest("" if v is None else str(v), seed) for v in values], np.uint64)


def _encoded(lat: Lattices, k: int, seed: int, keys: pa.Array, texts: pa.Array) -> Iterator[tuple[int, int, list[str], list[list[dict]]]]:
    """Ranges of rows with their texts and samples, of about ``CHUNK_CHARS`` characters each."""
    key = row_keys(keys.to_pylist(), seed)
    n = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    for i, j in chunks(n, CHUNK_CHARS):
        text = [t or "" for t in texts.slice(i, j - i).to_pylist()]
        yield i, j, text, encode_texts(lat, text, key[i:j], k)


def _samples(found: list[list[dict]], kind: pa.DataType) -> pa.Array:
    """The samples as an Arrow column, without a Python number for every piece."""
    flat = [x for own in found for x in own]
    ids = [x["ids"] for x in flat]
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    values = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))]
    values += [pa.array([x[c] for x in flat], pa.float64()) for c in ("log_prob", "perturbed", "log_inclusion")]
    rows = pa.StructArray.from_arrays(values, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in found]).astype(np.int32)), rows).cast(kind)


def encode(docs: DataFrame, model: str, *, k: int = K, seed: int = SEED, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``samples``: up to k segmentations with their scores."""
    cols = without(docs.columns, "samples")
    d, at = with_text(docs, text_col)
    (own,) = fresh(d.columns, "_key")
    d = d.withColumn(own, F.col(key_col).cast("string"))
    place = [d.columns.index(c) for c in cols]
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices.of(model)
        for b in slices(batches, at):
            for i, j, _, found in _encoded(lat, k, seed, b.column(len(b.columns) - 1), b.column(at)):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.select(place).columns), _samples(found, kind)], names=[*cols, "samples"])

    return d.mapInArrow(run, docs.select(*cols).withColumn("samples", F.lit(None).cast(SAMPLES)).schema)


def decode(df: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids in ``out_col``, in place of a column of that name; null ids give a null text."""
    cols = without(df.columns, out_col)
    place, at = [df.columns.index(c) for c in cols], df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices.of(model)
        for whole in batches:
            n = pc.fill_null(pc.list_value_length(whole.column(at)), 0).to_pylist()
            for i, j in chunks(n, CHUNK_CHARS):  # the ids as Python numbers take many times their size
                b = whole.slice(i, j - i)
                text = [None if x is None else decode_ids(lat, x).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.select(place).columns, pa.array(text, pa.string())], names=[*cols, out_col])

    return df.mapInArrow(run, df.select(*cols).withColumn(out_col, F.lit("")).schema)


def _digests(model: str, k: int, seed: int):
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices.of(model)
        for b in slices(batches, 2):
            for i, _, texts, found in _encoded(lat, k, seed, b.column(1), b.column(2)):
                rows = []
                for d, (text, samples) in enumerate(zip(texts, found), i):
                    raw = text.encode()
                    for s, x in enumerate(samples):
                        ids = x["ids"]
                        rows.append((b.column(0)[d].as_py(), s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), x["log_prob"], x["perturbed"], x["log_inclusion"], decode_array(lat, ids) == raw))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip"])

    return run


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every sampled segmentation of every document: its digest, scores, and whether decoding gives the text."""
    d = documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    return d.mapInArrow(_digests(default_model(), K, SEED), "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean")


def _checked(model: str, seed: int):
    """The samples of every document with the ids decoded again, in one pass: no text leaves the worker, which keeps no words after it."""
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices.of(model)
        try:
            for b in slices(batches, 2):
                for i, j, texts, found in _encoded(lat, K, seed, b.column(1), b.column(2)):
                    same = [all(decode_array(lat, x["ids"]) == t.encode() for x in own) for t, own in zip(texts, found)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _samples(found, kind), pa.array(same, pa.bool_())], ["doc_id", "samples", "round_trip"])
        finally:  # other stages run beside this worker when it is idle
            b = texts = found = same = None
            lat.clear()
            release()

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: ``K`` sampled segmentations of every document with their inclusion scores, decoded again as a check.

    ``ids`` and ``n_pieces`` are those of the first sample, whose perturbed value is the largest.
    """
    d = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    kind = docs.select("doc_id").withColumns({"samples": F.lit(None).cast(SAMPLES), "round_trip": F.lit(True)}).schema
    d = d.mapInArrow(_checked(default_model(), SEED), kind)
    ids = F.col("samples")[0]["ids"]
    return d.select("doc_id", ids.alias("ids"), F.size(ids).cast("long").alias("n_pieces"), "samples", "round_trip")
