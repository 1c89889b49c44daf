"""SentencePiece encoding by sampling without replacement, and decoding.

The k segmentations of a text with the largest Gumbel-perturbed log probabilities
are an exact sample without replacement. They are found best first, as by an
A-star search whose bound is exact: a branch of the lattice has as its perturbed
value the maximum of all segmentations below, drawn when the branch is reached,
and the search always opens the best branch that is left. The maximum goes down
along one ordinary sample of edges, so that opening a branch is one walk to the
end, taken for all words of many texts at once.

Lattices are made once for each distinct word of a batch. Random numbers come
from a hash of the seed, the row's key, the sample and the place in the text:
results don't depend on partitions, batches or order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from loupe.llm import textvec as V
from loupe.llm.common import read, small_batches, unused

MODEL = os.environ.get("LOUPE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")  # a file that every executor has
_SPACE, _NEWLINE = 0x20, 0x0A
BATCH_BYTES = 1 << 18
DECODE_IDS = 1 << 20


def _slot2(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).view(np.int64)


@dataclass
class Pieces:
    """Of a vocabulary, the bytes of each id, and by length the sorted hashes of pieces, with ids and log probabilities."""

    raw: np.ndarray
    start: np.ndarray
    size: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    prefixes: list[np.ndarray]  # of each length, which slots have a prefix of a piece
    logp: np.ndarray
    byte_id: np.ndarray
    byte_logp: float


def _raw_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """As textvec.span_hashes before mixing: spans of one length are compared only with each other."""
    p, inv = V._powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(V._BYTE[data] * p[: len(data)], out=c[1:])
    return (c[start + size] - c[start]) * inv[start]


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(46)).view(np.int64)


def _places(hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables from slots to places in hs: in the first a slot has its last hash, in the second those that lost theirs."""
    one, two = np.zeros(1 << 18, np.int16), np.zeros(1 << 18, np.int16)
    k = np.arange(len(hs))
    one[_slot(hs)] = k
    lost = k[one[_slot(hs)] != k]
    two[_slot2(hs[lost])] = lost
    if (two[_slot2(hs[lost])] != lost).any():
        raise ValueError("the vocabulary is too large for its tables")
    return one, two


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The vocabulary of a model file. A BPE model stores a piece's merge rank as its score; by Zipf's law that rank gives the piece's log probability."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    is_byte = np.array([sp.is_byte(i) for i in range(n)])
    normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
    score = np.array([sp.get_score(i) for i in range(n)])
    logp = -np.log(2 - np.minimum(score, 0)) if score[normal].min() < -1000 else score.copy()
    logp[normal] -= np.log(np.exp(logp[normal]).sum())
    byte_id = np.zeros(256, np.int32)
    blobs = []
    for i in range(n):
        name = sp.id_to_piece(i)
        if is_byte[i]:
            byte_id[int(name[3:5], 16)] = i
            blobs.append(bytes([int(name[3:5], 16)]))
        else:
            blobs.append(name.replace("▁", " ").encode() if normal[i] else b"")
    size = np.array([len(b) for b in blobs])
    raw, end = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(size)
    h = _raw_hashes(raw, end - size, size)
    by_length = {}
    for length in np.unique(size[normal]):
        ids = np.flatnonzero(normal & (size == length))
        ids = ids[np.argsort(h[ids])]
        by_length[int(length)] = (h[ids], ids.astype(np.int32), *_places(h[ids]))
    prefixes = [np.zeros(1, bool)]
    for length in range(1, int(size[normal].max()) + 1):
        ids = np.flatnonzero(normal & (size >= length))
        prefixes.append(np.zeros(1 << 18, bool))
        prefixes[-1][_slot(_raw_hashes(raw, (end - size)[ids], np.full(len(ids), length)))] = True
    return Pieces(raw, end - size, size, by_length, prefixes, logp, byte_id, float(logp[normal].min()) - 10)


class Lattice:
    """The lattices of some words. A node is a byte place; a node's edges stand together and their probabilities, given the node, sum to 1."""

    def __init__(self, p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.first = np.cumsum(size + 1) - size - 1
        total = int((size + 1).sum())
        at = np.arange(total) - np.repeat(self.first, size + 1)
        left = np.repeat(size, size + 1) - at  # bytes to the word's end
        buf = np.zeros(total, np.uint8)
        inner = left > 0
        buf[inner] = data[(np.repeat(start, size + 1) + at)[inner]]
        pw, inv = V._powers(total + 1)
        c = np.zeros(total + 1, np.uint64)
        np.cumsum(V._BYTE[buf] * pw[:total], out=c[1:])
        lead = inner & ((buf & 0xC0) != 0x80)
        char = np.ones(total, np.int64)
        char[buf >= 0xC0] = 2
        char[buf >= 0xE0] = 3
        char[buf >= 0xF0] = 4
        char = np.minimum(char, np.maximum(left, 1))
        covered = np.zeros(total, bool)
        frm, to, ids, lp = [], [], [], []
        nodes = np.flatnonzero(lead)
        on = nodes
        for length in range(1, len(p.prefixes)):  # nodes go on as long as what follows may begin a piece
            on = on[left[on] >= length]
            if not len(on):
                break
            h = (c[on + length] - c[on]) * inv[on]
            may = np.flatnonzero(p.prefixes[length][_slot(h)])
            on, h = on[may], h[may]
            if length not in p.by_length:
                continue
            hs, names, one, two = p.by_length[length]
            k = one[_slot(h)]
            bad = np.flatnonzero(hs[k] != h)
            k[bad] = two[_slot2(h[bad])]
            hit = np.ones(len(h), bool)
            hit[bad] = hs[k[bad]] == h[bad]
            hit = np.flatnonzero(hit)
            f, i = on[hit], names[k[hit]]
            covered[f[char[f] == length]] = True
            frm.append(f)
            to.append(f + length)
            ids.append(i)
            lp.append(p.logp[i])
        f = nodes[~covered[nodes]]  # such a character goes as its bytes, which are one edge with id -1
        frm.append(f)
        to.append(f + char[f])
        ids.append(np.full(len(f), -1, np.int32))
        lp.append(p.byte_logp * char[f])
        runs = list(zip(frm, to, ids, lp, strict=True))
        self.degree = np.zeros(total + 1, np.int32)
        for f, _, _, _ in runs:
            self.degree[f] += 1  # a run has one length, and so each node once
        # edges stand by the bytes to the word's end, so that each step back is one slice
        by_left = np.argsort(left.astype(np.uint16) if total and left.max() < 1 << 16 else left, kind="stable")
        self.edge0 = np.zeros(total + 1, np.int64)
        self.edge0[by_left] = np.cumsum(self.degree[by_left]) - self.degree[by_left]
        n = int(self.degree.sum())
        self.frm, self.to, self.ids, lp = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n)
        fill = self.edge0.copy()
        for f, t, i, w in runs:
            at_ = fill[f]
            self.frm[at_], self.to[at_], self.ids[at_], lp[at_] = f, t, i, w
            fill[f] += 1
        cuts = np.r_[0, np.cumsum(np.bincount(left, self.degree[:-1]))].astype(np.int64) if total else np.zeros(1, np.int64)
        beta, linear, weight = np.zeros(total), np.ones(total), np.exp(lp)
        starts = np.flatnonzero(np.r_[True, self.frm[1:] != self.frm[:-1]]) if n else np.zeros(0, np.int64)
        start_cuts = np.searchsorted(starts, cuts)
        for d in range(1, len(cuts) - 1):
            a, b = cuts[d], cuts[d + 1]
            if a == b:
                continue
            s = starts[start_cuts[d] : start_cuts[d + 1]]
            nodes_d = self.frm[s]
            if d <= 60:
                linear[nodes_d] = np.add.reduceat(weight[a:b] * linear[self.to[a:b]], s - a)
                beta[nodes_d] = np.log(linear[nodes_d])
            else:  # probabilities of long words would underflow
                v = lp[a:b] + beta[self.to[a:b]]
                top = np.maximum.reduceat(v, s - a)
                beta[nodes_d] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.r_[s, b]))), s - a))
        self.logq = lp + beta[self.to] - beta[self.frm]
        c = np.r_[0, np.cumsum(np.exp(self.logq))]
        self.cdf = c[1:] - np.repeat(c[starts], np.diff(np.r_[starts, n]))
        self.cdf[np.r_[starts[1:], n][: len(starts)] - 1] = np.inf
        self.last = left == 0
        self.bytes = char
        self.at = at


def _unit(key: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    x = V.mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xD1B54A32D192ED03) % (1 << 64)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _walk(lat: Lattice, node: np.ndarray, origin: np.ndarray, key: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """From each node to its word's end by sampled edges: how many edges each took, and all of them in order. origin: where in its text a word's node 0 stands."""
    n = len(node)
    who, cur, steps = np.arange(n), node, []
    live = ~lat.last[cur]
    who, cur = who[live], cur[live]
    while len(who):
        e = lat.edge0[cur]
        more = np.flatnonzero(lat.degree[cur] > 1)
        if len(more):
            u = _unit(key[who[more]], origin[who[more]] + lat.at[cur[more]], salt)
            while len(more):
                up = np.flatnonzero(u > lat.cdf[e[more]])
                more, u = more[up], u[up]
                e[more] += 1
        steps.append((who, e))
        cur = lat.to[e]
        live = np.flatnonzero(~lat.last[cur])
        who, cur = who[live], cur[live]
    count = np.zeros(n, np.int64)
    for w, _ in steps:
        count[w] += 1
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for s, (w, e) in enumerate(steps):
        out[at[w] + s] = e
    return count, out


@dataclass
class _Path:
    """One segmentation of a text: its edges with the words they are in, from branch on drawn by itself."""

    edge: np.ndarray
    word: np.ndarray
    before: np.ndarray  # log probability of all before each edge
    logp: float
    gumbel: float


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each; where words begin and end, a word being spaces and what follows, or one newline."""
    n = len(start)
    size = end - start + 1
    off = np.cumsum(size) - size
    buf = np.full(int(size.sum()), _SPACE, np.uint8)
    keep = np.ones(len(buf), bool)
    keep[off] = False
    buf[keep] = data
    space, nl = buf == _SPACE, buf == _NEWLINE
    head = nl.copy()
    head[off] = True
    head[1:] |= (space[1:] & ~space[:-1]) | nl[:-1]
    a = np.flatnonzero(head)
    return buf, a, np.r_[a[1:], len(buf)], np.r_[np.searchsorted(a, off), len(a)] if n else np.zeros(1, int)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    if len(score) <= k:
        return np.arange(len(score))
    return np.argpartition(-score, k - 1)[:k]


def sample(p: Pieces, texts: V.Texts, keys: np.ndarray, k: int, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, best perturbed value first: (ids, log probability, perturbed value, log of the chance of inclusion)."""
    data = texts.data[texts.start[0] : texts.end[-1]] if len(texts) else texts.data
    buf, a, b, doc = _words(data, texts.start, texts.end)
    h = V.span_hashes(buf, a, b)
    kind, distinct = pd.factorize(h)
    first = np.empty(len(distinct), np.int64)
    first[kind[::-1]] = np.arange(len(h))[::-1]
    lat = Lattice(p, buf, a[first], b[first])
    base = V.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1))
    owner = np.repeat(np.arange(len(texts)), np.diff(doc))
    doc_at = a[doc[:-1]] if len(texts) else a
    origin = a - doc_at[owner]
    node = lat.first[kind]
    count, edges = _walk(lat, node, origin, base[owner], 1)
    word = np.repeat(np.arange(len(a)), count)
    lq = lat.logq[edges]
    cum = np.r_[0, np.cumsum(lq)]
    cut = np.r_[0, np.cumsum(count)][doc]
    place = origin[word] + lat.at[lat.frm[edges]]
    many = np.flatnonzero(lat.degree[lat.frm[edges]] > 1)
    many_cut = np.searchsorted(many, cut)
    text_of = owner[word[many]]
    rest = np.log(np.maximum(-np.expm1(lq[many]), 1e-300))
    phi = cum[many] - cum[cut[text_of]] + rest
    free = -np.log(-np.log(_unit(base[text_of], place[many], 2)))
    root = -np.log(-np.log(_unit(base, np.zeros(len(texts), np.int64), 3)))
    perturbed = phi + free
    all_paths, heaps = [], []
    for d in range(len(texts)):
        lo, hi = cut[d], cut[d + 1]
        x = _Path(edges[lo:hi], word[lo:hi], cum[lo:hi] - cum[lo], float(cum[hi] - cum[lo]), float(root[d]))
        ml, mh = many_cut[d], many_cut[d + 1]
        all_paths.append([x])
        heaps.append(_branches(x, 0, many[ml:mh] - lo, phi[ml:mh], perturbed[ml:mh], k))
    for turn in range(1, k):
        _open_best(lat, all_paths, heaps, turn, k, base, origin, node, doc)
    out = []
    for paths, heap in zip(all_paths, heaps, strict=True):
        floor = max((x[0] for x in heap), default=-np.inf)
        got = []
        for x in paths:
            ids = lat.ids[x.edge]
            odd = np.flatnonzero(ids < 0)
            if len(odd):
                place_ = a[x.word[odd]] + lat.at[lat.frm[x.edge[odd]]]
                long = lat.bytes[lat.frm[x.edge[odd]]]
                cells = np.ones(len(ids), np.int64)
                cells[odd] = long
                ids = np.repeat(ids, cells)
                ids[ids < 0] = p.byte_id[buf[np.repeat(place_ - np.cumsum(long) + long, long) + np.arange(long.sum())]]
            got.append((ids, x.logp, x.gumbel, _log_inclusion(x.logp - floor)))
        out.append(got)
    return out


def _branches(path: _Path, i: int, at: np.ndarray, log_rest: np.ndarray, noisy: np.ndarray, k: int) -> list[tuple[float, int, int, float, tuple[int, ...]]]:
    """The k best branches off a path: (perturbed value, path, place of its edge, log probability of what is left there, edges that are taken there)."""
    best = _top(noisy, k)
    value = -np.logaddexp(-path.gumbel, -noisy[best])
    return [(v, i, x, r, (int(path.edge[x]),)) for v, x, r in zip(value.tolist(), at[best].tolist(), log_rest[best].tolist(), strict=True)]


def _open_best(lat: Lattice, all_paths: list, heaps: list, turn: int, k: int, base: np.ndarray, origin: np.ndarray, node: np.ndarray, doc: np.ndarray) -> None:
    """Opens the best branch of every text that has one: draws its edge, walks to the text's end, and puts the new branches on the heap."""
    salt = 1 + 3 * turn
    picks = [(d, heap.pop(max(range(len(heap)), key=lambda i: heap[i][0]))) for d, heap in enumerate(heaps) if heap]
    if not picks:
        return
    ds = np.array([d for d, _ in picks])
    word = np.array([all_paths[d][x[1]].word[x[2]] for d, x in picks])
    first = np.array([all_paths[d][x[1]].edge[x[2]] for d, x in picks])
    v = lat.frm[first]
    here = origin[word] + lat.at[v]
    u, g = _unit(base[ds], here, salt), -np.log(-np.log(_unit(base[ds], here, salt + 1)))
    chosen = np.empty(len(ds), np.int64)
    for j, (d, (value, src, at, _, taken)) in enumerate(picks):
        e0 = int(lat.edge0[v[j]])
        options = [e for e in range(e0, e0 + int(lat.degree[v[j]])) if e not in taken]
        q = np.exp(lat.logq[options])
        e = options[min(int(np.searchsorted(np.cumsum(q), u[j] * q.sum())), len(options) - 1)]
        chosen[j] = e
        if len(options) > 1:  # the rest of this branch stays, below what was drawn from it
            left = float(all_paths[d][src].before[at] + np.log(max(q.sum() - np.exp(lat.logq[e]), 1e-300)))
            heaps[d].append((-float(np.logaddexp(-value, -left - g[j])), src, at, left, (*taken, e)))
    size = doc[ds + 1] - word
    off = np.cumsum(size) - size
    words = np.repeat(word - off, size) + np.arange(int(size.sum()))
    start = node[words]
    start[off] = lat.to[chosen]
    key = np.repeat(base[ds], size)
    count, edges = _walk(lat, start, origin[words], key, salt)
    of_edge = np.repeat(np.arange(len(words)), count)
    ends = np.r_[0, np.cumsum(count)][np.r_[off, len(words)]]
    lq = lat.logq[edges]
    cum = np.r_[0, np.cumsum(lq)]
    f = lat.frm[edges]
    many = np.flatnonzero(lat.degree[f] > 1)
    many_cut = np.searchsorted(many, ends)
    noise = -np.log(-np.log(_unit(key[of_edge[many]], origin[words[of_edge[many]]] + lat.at[f[many]], salt + 2)))
    rest = np.log(np.maximum(-np.expm1(lq[many]), 1e-300))
    ewords = words[of_edge]
    for j, (d, (value, src, at, _, _)) in enumerate(picks):
        old, lo, hi, e = all_paths[d][src], ends[j], ends[j + 1], chosen[j]
        begin = float(old.before[at] + lat.logq[e])
        before = np.concatenate([old.before[: at + 1], cum[lo:hi] - cum[lo] + begin])
        new = _Path(np.concatenate([old.edge[:at], [e], edges[lo:hi]]), np.concatenate([old.word[:at], [word[j]], ewords[lo:hi]]), before, begin + float(cum[hi] - cum[lo]), value)
        all_paths[d].append(new)
        ml, mh = many_cut[j], many_cut[j + 1]
        places = many[ml:mh] - lo + at + 1
        log_rest = before[places] + rest[ml:mh]
        heaps[d] += _branches(new, len(all_paths[d]) - 1, places, log_rest, log_rest + noise[ml:mh], k)


def _log_inclusion(d: float) -> float:
    """log(1 - exp(-exp(d))): the chance that a segmentation's perturbed value exceeds the first one that is not in the sample."""
    if d > 4:
        return 0.0
    return float(d) if d < -30 else float(np.log(-np.expm1(-np.exp(d))))


def decode_ids(p: Pieces, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts whose ids are ids[cut[i]:cut[i + 1]], and where each text begins in them, without the space that encoding put first."""
    size = p.size[ids]
    end = np.cumsum(size)
    raw = p.raw[np.repeat(p.start[ids] - end + size, size) + np.arange(int(size.sum()))]
    ends = np.r_[0, end][cut]
    begin = ends[:-1]
    keep = np.ones(len(raw), bool)
    full = begin[ends[1:] > begin]
    keep[full[raw[full] == _SPACE]] = False
    dropped = np.r_[0, np.cumsum(~keep)]
    return raw[keep], ends - dropped[ends]


_OUT = [("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_())]


def _encode_batches(path: str, k: int, seed: int, keep: int, names: list[str]):  # noqa: ANN202
    """names: of the output columns after the keep ones that are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in batches:
            row = 0
            keys = b.column(keep + 1).to_numpy(zero_copy_only=False)
            for t in V.pieces(b.column(keep), BATCH_BYTES):
                n = len(t)
                got = sample(p, t, keys[row : row + n], k, seed)
                flat = [x for d in got for x in d]
                owner = np.repeat(np.arange(n), [len(d) for d in got])
                cut = np.r_[0, np.cumsum([len(x[0]) for x in flat])].astype(np.int64)
                ids = np.concatenate([x[0] for x in flat]) if flat else np.zeros(0, np.int32)
                raw, off = decode_ids(p, ids, cut)
                same = [np.array_equal(raw[s:e], t.data[t.start[o] : t.end[o]]) for s, e, o in zip(off[:-1], off[1:], owner, strict=True)]
                take = pa.array(owner + row)
                cols = [b.column(i).take(take) for i in range(keep)]
                cols += [pa.array([i + 1 for d in got for i in range(len(d))], pa.int32()), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                cols += [pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)] + [pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:keep], *names])
                row += n

    return run


def encode(docs: DataFrame, k: int = 2, model: str = MODEL, seed: int = 0, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Up to k rows a document: carry, sample (1 the best), ids, log_prob, perturbed, log_inclusion, round_trip (whether decoding gives the text).

    k distinct segmentations, or all where a text has fewer; their ids may agree
    only if pieces do. The row key is doc_id, or a hash of the text without one,
    so that repeated rows get the same. A carried column with the name of an output stays, and
    the output gets underscores. A null or empty text has the one piece of
    the space that is put first. Of docs only the columns in carry go on; each row
    is worked on by itself, over its whole text. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in carry])
    names = [unused(rows, n) for n, _ in _OUT]
    text, key = unused(rows, "text_"), unused(rows, "key_")
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias(text), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias(key))
    schema = StructType([*[StructField(c, docs.schema[c].dataType) for c in carry], *[StructField(n, from_arrow_type(t)) for n, (_, t) in zip(names, _OUT, strict=True)]])
    return rows.mapInArrow(_encode_batches(model, k, seed, len(carry), names), schema)


def _runs(length: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many in all, or of one row."""
    end, a = np.cumsum(length), 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def decode(rows: DataFrame, model: str = MODEL, column: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null, none give an empty text; worked on in runs of DECODE_IDS ids, so that no batch is too large. A column of that name stays and the new one gets underscores."""

    def run(ids: pa.Array) -> pa.Array:
        p, parts = load(model), []
        length = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _runs(length, DECODE_IDS):
            part = ids.slice(a, b - a)
            raw, off = decode_ids(p, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(length[a:b])])
            parts.append(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string()))
        got = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return pc.if_else(ids.is_null(), None, got) if ids.null_count else got

    small_batches(rows.sparkSession)
    return rows.withColumn(unused(rows, column), F.arrow_udf(run, "string")("ids"))


def op6_sentencepiece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, and whether they decode to it."""
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
