"""Embeddings: near-dedup by spherical k-means cells, and nearest neighbours by learned partitions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.llm.common import components, materialize, read, small_batches, unused

BLOCK_ROWS = 2048
BLOCK_ROUTED = 32768
_VEC = "id long, v array<float>"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def _vectors(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * (m.shape[1] if m.ndim == 2 else 1), pa.int32()), pa.array(m.ravel(), pa.float32()))


def unit_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): vectors of length 1, one for each id.

    Left out: null ids and vectors, vectors of another size than most have (the
    smaller size on ties), with a null, a NaN or an infinity in them, or of length
    0. Where several rows have one id, the least vector counts.
    """
    small_batches(rows.sparkSession)
    v = rows.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v")).where("id is not null and v is not null")
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    v = v.where(F.size("v") == (sizes["d"] if sizes else 0)).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = v.groupBy("id").agg(F.min("v").alias("v"))

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1)).astype(np.float64)
            size = np.sqrt((m * m).sum(1))
            ok = size > 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), _vectors((m[ok] / size[ok, None]).astype(np.float32))], ["id", "v"])

    return v.mapInArrow(norm, _VEC)


def _first_by_hash(vecs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = vecs.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.array([r["id"] for r in got]), np.array([r["v"] for r in got], np.float32).reshape(len(got), -1)


def _sum_cells(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, count = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
    for b in batches:
        m = _matrix(b.column(1))
        if len(m):
            best = np.argmax(m @ centroids.T, axis=1)
            np.add.at(total, best, m)
            count += np.bincount(best, minlength=len(centroids))
    has = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * total.shape[1], pa.int32()), pa.array(total[has].ravel()))], ["cell", "total"])


def _add(t: pa.Table) -> pa.Table:
    total = np.stack([np.array(x) for x in t["total"].to_pylist()]).sum(0)
    return pa.table({"cell": pa.array([t["cell"][0].as_py()], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def spherical_kmeans(vecs: DataFrame, n: int, rounds: int = 5) -> np.ndarray:
    """About root of n centroids of length 1, so that finding cells and comparing within them cost the same power of n. Every round sums over all vectors."""
    _, c = _first_by_hash(vecs, max(1, int(np.ceil(np.sqrt(n)))))
    for _ in range(rounds):
        sums = vecs.mapInArrow(lambda it, c=c: _sum_cells(it, c), "cell int, total array<double>")
        got = sums.groupBy("cell").applyInArrow(_add, "cell int, total array<double>").collect()
        for r in got:
            t = np.array(r["total"])
            size = np.sqrt(t @ t)
            if size > 0:
                c[r["cell"]] = t / size
    return c


def _adjacent_groups(near: np.ndarray) -> np.ndarray:
    """Each row's group leader in a symmetric boolean matrix."""
    n = len(near)
    lead = np.full(n, -1)
    for i in range(n):
        if lead[i] >= 0:
            continue
        lead[i] = i
        front = [i]
        while front:
            new = np.flatnonzero(near[front.pop()] & (lead < 0))
            lead[new] = i
            front.extend(new)
    return lead


def near_vector_edges(vecs: DataFrame, centroids: np.ndarray, cosine: float, probes: int) -> DataFrame:
    """(a, b) edges that connect vectors of at least that cosine which share one of their probes nearest cells."""
    probes = min(probes, len(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1))
            if not len(m):
                continue
            s = m @ centroids.T
            top = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            take = pa.array(np.repeat(np.arange(len(m)), top.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(top.ravel(), pa.int32()), b.column(0).take(take), b.column(1).take(take)], ["cell", "id", "v"])

    cells = vecs.mapInArrow(assign, f"cell int, {_VEC}")
    # a cell of many rows is cut into blocks, and every pair of blocks is a group of its own
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    c = cells.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    c = c.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "v")

    def compare(t: pa.Table) -> pa.Table:
        ids, m = t["id"].to_numpy(), _matrix(t["v"])
        lead = _adjacent_groups(m @ m.T >= cosine)
        other = lead != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[other], pa.int64()), "b": pa.array(ids[lead[other]], pa.int64())})

    return c.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicate_vectors(rows: DataFrame, cosine: float = 0.95, probes: int = 6, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id_column, rep_id, kept) for each id of rows: groups are connected by pairs of at least that cosine, and the least id of each is kept.

    A pair is found if it shares one of the probes nearest cells of each; that
    misses few (see README.md). What unit_vectors leaves out is a group by itself.
    Repeated ids give one row; null ids none; an empty table none.
    """
    ids = rows.select(F.col(id_column).cast("long").alias("id")).where("id is not null").distinct()
    vecs = materialize(unit_vectors(rows, id_column, column), "vecs")
    n = vecs.count()
    if not n:
        return ids.select(F.col("id").alias(id_column), F.col("id").alias("rep_id"), F.lit(True).alias("kept"))
    edges = near_vector_edges(vecs, spherical_kmeans(vecs, n), cosine, probes)
    roots = components(edges)
    j = ids.join(roots, ids["id"] == roots["node"], "left").withColumn("rep_id", F.coalesce("root", "id"))
    return j.select(F.col("id").alias(id_column), "rep_id", (F.col("id") == F.col("rep_id")).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the one that stands for its group."""
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
with recursive e as (
  select a.vec_id a, b.vec_id b from embeddings a join embeddings b
  on list_cosine_similarity(a.embedding, b.embedding) >= 0.95),
reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
select a vec_id, min(b) rep_id, a = min(b) kept from reach group by a
"""


@dataclass
class Router:
    """A network of one hidden layer: the probabilities of a vector's neighbours to be in each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    offset: np.ndarray  # makes partitions of all rows even

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.logits(x) + self.offset, axis=1)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def partition_graph(x: np.ndarray, graph: np.ndarray, m: int, rounds: int = 12, slack: float = 0.05) -> np.ndarray:
    """A balanced partition of the graph with few cut edges: halves along principal directions, then moves that gain most, while sizes stay within slack."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, m)]
    while todo:
        rows, first, parts = todo.pop()
        if parts == 1:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        v = np.linalg.eigh(y.T @ y)[1][:, -1]
        order = rows[np.argsort(y @ v, kind="stable")]
        half = parts // 2
        cut = len(rows) * half // parts
        todo += [(order[:cut], first, half), (order[cut:], first + half, parts - half)]
    most = int(np.ceil(len(x) / m * (1 + slack)))
    for _ in range(rounds):
        votes = np.zeros((len(x), m), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        best = np.argmax(votes, axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        moved = 0
        size = np.bincount(label, minlength=m)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[best[i]] += 1
                size[label[i]] -= 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def train_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, m: int, hidden: int = 64, epochs: int = 30, seed: int = 0) -> Router:
    """Learns, for each sample row, how its neighbours spread over partitions."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    y = np.zeros((len(x), m), np.float32)
    np.add.at(y, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1 / max(1, graph.shape[1]))
    y = 0.5 * y + 0.5 * np.eye(m, dtype=np.float32)[label]
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, m)), np.zeros(m)]
    p = [a.astype(np.float32) for a in p]
    m1, m2, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            xb, yb = x[order[a : a + 256]], y[order[a : a + 256]]
            h = np.maximum(xb @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(1, keepdims=True))
            dz = (q / q.sum(1, keepdims=True) - yb) / len(xb)
            dh = (dz @ p[2].T) * (h > 0)
            t += 1
            for k, g in enumerate([xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= 0.005 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    r = Router(*p, np.zeros(m, np.float32))
    z = r.logits(x)
    for _ in range(200):  # shifts logits until the sample's rows are even
        size = np.bincount(np.argmax(z + r.offset, axis=1), minlength=m)
        r.offset -= 0.05 * (size / (len(x) / m) - 1).clip(-2, 2).astype(np.float32)
    return r


def _best(t: pa.Table, q: np.ndarray, qid: np.ndarray, k: int, part: int | None = None) -> pa.Table:
    """The k best rows of t (id, v) for each query, not itself; ties go to the lesser id."""
    order = np.argsort(t["id"].to_numpy(), kind="stable")
    ids, m = t["id"].to_numpy()[order], _matrix(t["v"])[order]
    rows, cols, vals = [], [], []
    for a in range(0, len(q), 1024):
        s = q[a : a + 1024] @ m.T
        s[qid[a : a + 1024, None] == ids[None, :]] = -np.inf
        n = min(k + 1, s.shape[1])
        kth = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        kth = np.where(n > k, -np.partition(-s, k - 1, axis=1)[:, k - 1] if n > k else kth, kth)
        r, c = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
        rows.append(r + a)
        cols.append(c)
        vals.append(np.einsum("ij,ij->i", q[r + a].astype(np.float64), m[c].astype(np.float64)))
    r, c, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, vals))
    out = {"q": pa.array(qid[r], pa.int64()), "id": pa.array(ids[c], pa.int64()), "cosine": pa.array(v.astype(np.float64), pa.float64())}
    if part is not None:
        out["part"] = pa.array(np.full(len(r), part), pa.int32())
    return pa.table(out)


@dataclass
class PartitionIndex:
    router: Router
    parts: int  # of both levels
    probes: tuple[int, int]  # partitions of the first level a query is sent to, and of each of them at the second
    recall: float  # as measured on test_rows rows that the router was not trained on
    base: DataFrame  # part, id, v
    routers: DataFrame | None = None  # part, router: of the second level
    below: int = 1  # partitions of the second level in one of the first


def build_index(vecs: DataFrame, n: int, k: int, sample_rows: int = 8192, part_rows: int = 2048, most_parts: int = 1024, target: float = 0.95, test_rows: int = 512) -> PartitionIndex:
    """An index over all of vecs, of about part_rows rows a partition.

    Graph and router are learned from a sample of sample_rows rows, chosen by hash,
    which the driver holds, for at most most_parts partitions (eight rows of the sample
    each). If more are needed, each of these is divided in the same way once more, by a
    router that a task learns from sample_rows rows of it: up to most_parts squared in
    all, two thousand million rows as the numbers are; beyond that partitions grow, and
    are searched in blocks. The numbers of probes are the least with which the neighbours
    of test_rows further rows, by brute force over all, reach the target recall. A table
    of at most part_rows rows has one partition and is exact.
    """
    want = max(1, -(-n // part_rows))
    m, below = min(want, most_parts), min(-(-want // most_parts), most_parts)
    sample_rows = min(sample_rows, n)
    ids, x = _first_by_hash(vecs, sample_rows + test_rows)
    qid, q, x = ids[sample_rows:], x[sample_rows:], x[:sample_rows]
    if not len(q):  # all rows are in the sample
        qid, q = ids[:test_rows], x[:test_rows]
    router = _fit_router(x, m)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(router.home(_matrix(b.column(1))), pa.int32()), b.column(0), b.column(1)], ["part", "id", "v"])

    base = materialize(vecs.mapInArrow(assign, f"part int, {_VEC}"), "base")
    if m == 1:
        return PartitionIndex(router, 1, (1, 1), 1.0, base)
    routers = None
    if below > 1:
        routers = materialize(_second_level(base, below, sample_rows), "routers")
        base = materialize(_divide(base, routers, below, 1, n // m).select("part", "id", "v"), "base")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    true = brute_force(base, qid, q, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "part").toPandas()
    turn = np.argsort(np.argsort(-(router.logits(q) + router.offset), axis=1, kind="stable"), axis=1, kind="stable")
    row = pd.Series(np.arange(len(qid)), qid)[true["q"]].to_numpy()
    first = turn[row, true["part"] // below]
    second = np.zeros(len(true), np.int64)
    if routers is not None:
        asked = pd.DataFrame({"part": true["part"] // below, "id": true["q"]}).drop_duplicates()
        asked["v"] = [q[i].tolist() for i in pd.Series(np.arange(len(qid)), qid)[asked["id"]]]
        turns = _divide(vecs.sparkSession.createDataFrame(asked, f"part int, {_VEC}"), routers, below, below, len(asked)).select(F.col("id").alias("q"), "part", "turn").toPandas()
        second = true.merge(turns.drop_duplicates(["q", "part"]), "left", ["q", "part"])["turn"].to_numpy()
    # the first level may lose half of what is lost in all
    least = target if routers is None else (1 + target) / 2
    p1 = next(p for p in range(1, m + 1) if (first < p).mean() >= least)
    got = [((first < p1) & (second < p)).mean() for p in range(1, below + 1)]
    p2 = next((p for p, r in enumerate(got, 1) if r >= target), below)
    return PartitionIndex(router, m * below, (p1, p2), float(got[p2 - 1]), base, routers, below)


def _fit_router(x: np.ndarray, m: int) -> Router:
    if m <= 1 or len(x) < 2:
        return _one_partition(x.shape[1])
    graph = neighbour_graph(x, 10)
    return train_router(x, graph, partition_graph(x, graph, m), m)


def _second_level(base: DataFrame, below: int, sample_rows: int) -> DataFrame:
    """(part, router) for each partition of base, learned from sample_rows rows of it by hash."""
    w = Window.partitionBy("part").orderBy(F.xxhash64("id"), "id")
    drawn = base.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= sample_rows).drop("turn")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = _matrix(t["v"])
        return pa.table({"part": t["part"][:1].combine_chunks(), "router": pa.array([pickle.dumps(_fit_router(x, min(below, len(x))))], pa.binary())})

    return drawn.groupBy("part").applyInArrow(fit, "part int, router binary")


def _divide(rows: DataFrame, routers: DataFrame, below: int, top: int, part_rows: int) -> DataFrame:
    """(part, id, v, turn): rows (part, id, v) in the top best partitions of the second level, turn from 0 the best first. Blocks of rows meet their router, so that a large partition is no large task."""
    blocks = max(1, -(-part_rows // BLOCK_ROUTED))
    left = rows.select("part", "id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    right = routers.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def go(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            a = a.slice(0, 0)
            return pa.table({"part": a["part"], "id": a["id"], "v": a["v"], "turn": pa.array([], pa.int32())})
        r = pickle.loads(b["router"][0].as_py())
        z = r.logits(_matrix(a["v"])) + r.offset
        best = np.argsort(-z, axis=1, kind="stable")[:, :top]
        take = pa.array(np.repeat(np.arange(len(z)), best.shape[1]))
        part = a["part"][0].as_py() * below + best.ravel()
        turn = np.tile(np.arange(best.shape[1]), len(z))
        return pa.table({"part": pa.array(part, pa.int32()), "id": a["id"].take(take), "v": a["v"].take(take), "turn": pa.array(turn, pa.int32())})

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(go, f"part int, {_VEC}, turn int")


def _one_partition(d: int) -> Router:
    z = np.zeros(1, np.float32)
    return Router(np.zeros((d, 1), np.float32), z, np.zeros((1, 1), np.float32), z, z)


def brute_force(base: DataFrame, qid: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(q, id, cosine, part): of each task's rows of base (part, id, v) the k best of each query. The queries go to all tasks; they are as many as build_index asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in np.unique(b.column(0).to_numpy()):
                t = pa.Table.from_batches([b.filter(pc.equal(b.column(0), int(p)))])
                yield from _best(t, q, qid, k, int(p)).combine_chunks().to_batches()

    return base.mapInArrow(run, "q long, id long, cosine double, part int")


def search(index: PartitionIndex, queries: DataFrame, n_queries: int, n_base: int, k: int) -> DataFrame:
    """(q, rank, id, cosine): for every row of queries (id, v) its k best of the index, reranked by their cosine, without itself."""
    router, (probes, second) = index.router, index.probes
    blocks: Callable[[int], int] = lambda n: max(1, -(-n // index.parts // BLOCK_ROUTED))
    qb, bb = blocks(n_queries * probes * second), blocks(n_base)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = router.logits(_matrix(b.column(1))) + router.offset
            top = np.argpartition(-z, probes - 1, axis=1)[:, :probes] if probes < z.shape[1] else np.broadcast_to(np.arange(z.shape[1]), z.shape)
            take = pa.array(np.repeat(np.arange(len(z)), top.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(top.ravel(), pa.int32()), b.column(0).take(take), b.column(1).take(take)], ["part", "id", "v"])

    sent = queries.select("id", "v").mapInArrow(route, f"part int, {_VEC}")
    if index.routers is not None:
        sent = _divide(sent, index.routers, index.below, second, n_queries * probes // max(1, index.parts // index.below)).drop("turn")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = sent.withColumn("qb", one(qb)).withColumn("bb", every(bb))
    right = index.base.withColumn("bb", one(bb)).withColumn("qb", every(qb))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        return _best(b, _matrix(a["v"]), a["id"].to_numpy(), k)

    keys = ["part", "qb", "bb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "q long, id long, cosine double")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "rank", "id", "cosine")


def nearest_neighbours(rows: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", queries: Column | str = "true", part_rows: int = 2048) -> DataFrame:
    """(id_column, rank, neighbour_id, cosine): the k nearest others, among all of rows, of every vector of rows for which queries is true; by cosine, then the lesser id.

    queries is a condition on the column id. Vectors that unit_vectors leaves out
    neither ask nor are found; repeated ids count once; fewer than k others give fewer
    rows; no queries and an empty table give none; further columns don't matter.
    """
    vecs = materialize(unit_vectors(rows, id_column, column), "vecs")
    n = vecs.count()
    if not n:
        return vecs.select(F.col("id").alias(id_column), F.lit(1).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0.0).alias("cosine"))
    asked = vecs.where(queries)
    found = search(build_index(vecs, n, k, part_rows=part_rows), asked, asked.count(), n, k)
    return found.select(F.col("q").alias(id_column), "rank", F.col("id").alias(unused(rows.select(id_column), "neighbour_id")), "cosine")


ASKED = "id % 50 = 0"


def op8_learned_partitions_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all vectors, of every vector whose id is divisible by 50."""
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), queries=ASKED).withColumn("cosine", F.round("cosine", 3))


def op8_recall_of_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_queries, n_true, reached): how many neighbours the same queries have by brute force, and whether an index of small partitions finds nine tenths of them."""
    rows = read(spark, sf_dir, "embeddings")
    found = nearest_neighbours(rows, queries=ASKED, part_rows=64).select("vec_id", "neighbour_id", F.lit(1).alias("hit"))
    vecs = materialize(unit_vectors(rows), "vecs")
    n = vecs.count()
    true = search(build_index(vecs, n, 10, part_rows=max(1, n)), vecs.where(ASKED), vecs.where(ASKED).count(), n, 10)
    j = true.select(F.col("q").alias("vec_id"), F.col("id").alias("neighbour_id")).join(found, ["vec_id", "neighbour_id"], "left")
    return j.agg(F.countDistinct("vec_id").alias("n_queries"), F.count("*").alias("n_true"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


OP8_SQL = """
with p as (
  select a.vec_id, b.vec_id neighbour_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by vec_id order by c desc, neighbour_id) rank from p)
select vec_id, rank::int rank, neighbour_id, round(c, 3) cosine from r where rank <= 10
"""
OP8_RECALL_SQL = """
select count(*) n_queries, sum(least(10, (select count(*) from embeddings) - 1))::bigint n_true, true reached
from embeddings where vec_id % 50 = 0
"""
