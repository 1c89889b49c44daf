"""Module graphs: edges from imports, reachability, strongly connected components, cycles, fan-in."""

from __future__ import annotations

import re
import tempfile
from array import array
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.model import findings
from loupe.session import ship


ONE_TASK = 10_000_000


def module_name(path: Column, root: str = "") -> Column:
    """The dotted name of a file below root; a package's __init__ is the package, the root's own is __main__."""
    rel = F.regexp_replace(path, "^" + "".join("\\" + c if not c.isalnum() and c != "_" else c for c in root.rstrip("/")) + "/+", "") if root else path
    base = F.regexp_replace(F.regexp_replace(rel, r"(^|/)__init__\.pyi?$", ""), r"\.py[iw]?$", "")
    dotted = F.replace(base, F.lit("/"), F.lit("."))
    return F.when(dotted == "", "__main__").otherwise(dotted)


def modules(files: DataFrame, root: str = "") -> DataFrame:
    return files.where(F.col("file_path").rlike(r"\.py[iw]?$")).select("file_path", module_name(F.col("file_path"), root).alias("module_name"))


def imports(facts: DataFrame) -> DataFrame:
    """(file_path, module_name, import_type, line_number, is_conditional, is_type_checking, level); a from-import is one row, and one of dots alone none."""
    a = F.col("attrs")
    rows = facts.where("kind = 'import' and name <> '' and (attrs['type'] = 'import' or attrs['first'] = 'true')")
    return rows.select("file_path", F.col("name").alias("module_name"), a["type"].alias("import_type"), F.col("line").alias("line_number"), (a["conditional"] == "true").alias("is_conditional"), (a["type_checking"] == "true").alias("is_type_checking"), a["level"].cast("int").alias("level"))


def edges(imports_: DataFrame, modules_: DataFrame, external: bool = False) -> DataFrame:
    """(src, dst, line) of imports of modules that are there, also below src, and with external of others by their name; line is the first that has it. Relative names drop as many parts of the importing module as they have dots."""
    i = imports_.join(modules_.withColumnRenamed("module_name", "src"), "file_path")
    parts = F.split("src", r"\.")
    left = F.size(parts) - F.col("level")
    up = F.when(left >= 0, F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), F.array("module_name")))
    i = i.withColumn("target", F.when(F.col("level") > 0, F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), F.array("module_name")), ".")).otherwise(F.col("module_name")))
    i = i.where((F.col("level") == 0) | up.isNotNull())
    names = modules_.select(F.col("module_name").alias("dst"))
    known = names.withColumn("target", F.col("dst")).union(names.where("dst like 'src.%'").withColumn("target", F.substring("dst", F.lit(5), F.length("dst")))).distinct()
    i = i.join(known, "target", "left" if external else "inner").withColumn("dst", F.coalesce("dst", "target"))
    return i.groupBy("src", "dst").agg(F.min("line_number").alias("line"))


def reach(edges_: DataFrame, most_rounds: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """(src, dst): every pair with a path. The result may have a row for each pair of nodes: for large graphs give only edges around what is asked for.

    Of at most one_task edges, each task has the whole graph as arrays and finds what its
    sources reach, so that only the result grows with the pairs, and none are shuffled or
    kept. More edges go by doubling path lengths; each round is checkpointed. Both give
    the same. A null leads somewhere or is led to, but nothing goes through it.
    """
    spark = edges_.sparkSession
    ship(spark)
    paths = _cut(edges_.select("src", "dst").distinct())
    n = paths.count()
    if n <= one_task:
        return _reached(paths) if n else paths
    for _ in range(most_rounds):
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        paths = _cut(paths.union(longer).distinct())
        m = paths.count()
        if m == n:
            return paths
        n = m
    raise RuntimeError(f"paths grow after {most_rounds} rounds")


PAIRS_A_TASK = 4_000_000
PAIRS_A_BATCH = 100_000
SEEN = 32 << 20


def _reached(e: DataFrame) -> DataFrame:
    """reach of distinct edges, each task by walks or by a breadth-first search from its sources over the whole graph."""
    spark, t = e.sparkSession, e.toArrow()
    nodes, src, dst = _coded(t)
    n = len(nodes) + 2  # the last two: null that leads somewhere, null that is led to
    first, to = _lists(src, dst, n)
    sources = np.flatnonzero(np.diff(first)).astype(np.int32)
    tasks = 4 * spark.sparkContext.defaultParallelism
    steps = None
    if int(np.diff(first).max()) <= 1:
        steps = _steps(first, to, n)[sources]
        order = np.argsort(-steps, kind="stable")
        sources, steps = sources[order], steps[order]
        tasks = max(tasks, int(steps.sum(dtype=np.int64)) // PAIRS_A_TASK)
    tasks = min(tasks, len(sources))
    kinds = [f.type for f in t.schema]
    g = spark.sparkContext.broadcast((nodes, first, to, sources, steps))
    del t, src, dst

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, to, sources, steps = g.value
        known = pa.array(names)
        names = pa.concat_arrays([known, pa.nulls(2, known.type)])
        for batch in batches:
            for part in batch.column(0).to_pylist():
                found = _breadth(first, to, sources[part::tasks]) if steps is None else _walks(first, to, sources[part::tasks], steps[part::tasks])
                for a, b in found:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(x)).cast(kind) for x, kind in zip((a, b), kinds, strict=True)], ["src", "dst"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(work, e.schema)


def _coded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes, and both ends of each edge as places among them; a null is the place after the last as src, and the one after that as dst."""
    ends = [t[c].combine_chunks() for c in ("src", "dst")]
    known = [x.drop_null().to_numpy(zero_copy_only=False) for x in ends]
    nodes = np.unique(np.concatenate(known))
    coded = []
    for i, (x, k) in enumerate(zip(ends, known, strict=True)):
        c = np.full(len(x), len(nodes) + i, np.int32)
        c[np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))] = np.searchsorted(nodes, k)
        coded.append(c)
    return nodes, coded[0], coded[1]


def _lists(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, to): the edges of v go to to[first[v] : first[v + 1]]."""
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).astype(np.int64), dst[order]


def _out(first: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of edges of each of v, and the places of all of them."""
    n = first[v + 1] - first[v]
    return n, np.repeat(first[v] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _peeled(first: np.ndarray, to: np.ndarray, n: int) -> list[np.ndarray]:
    """Nodes that nothing leads to, then those that only nodes before lead to, and so on: all that are on no cycle and behind none."""
    into = np.bincount(to, minlength=n)
    levels = [np.flatnonzero(into == 0)]
    while len(levels[-1]):
        u, k = np.unique(to[_out(first, levels[-1])[1]], return_counts=True)
        into[u] -= k
        levels.append(u[into[u] == 0])
    return levels[:-1]


def _steps(first: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """How many nodes each reaches, where no node has more than one edge."""
    has = np.diff(first) > 0
    after = np.full(n, -1, np.int32)
    after[has] = to
    steps = np.full(n, -1, np.int32)
    levels = _peeled(first, to, n)
    for x in levels:
        steps[x] = 0
    on_ring = steps < 0  # such a node reaches itself
    for v in np.flatnonzero(on_ring).tolist():
        if steps[v] < 0:
            ring = [v]
            while (v := int(after[v])) != ring[0]:
                ring.append(v)
            steps[ring] = len(ring)
    for x in reversed(levels):
        x = x[has[x]]
        steps[x] = steps[after[x]] + ~on_ring[after[x]]
    return steps


def _walks(first: np.ndarray, to: np.ndarray, sources: np.ndarray, steps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sources of one edge and the nodes after them, as many as steps says; steps falls."""
    now, turn, out, n = sources, 0, [], 0
    live = np.searchsorted(-steps, -np.arange(int(steps[0]) if len(steps) else 0), side="left")
    for m in live.tolist():
        now = to[first[now[:m]]]
        out.append((sources[:m], now))
        n += m
        turn += 1
        if n >= PAIRS_A_BATCH or turn == len(live):
            yield np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
            out, n = [], 0


def _breadth(first: np.ndarray, to: np.ndarray, sources: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sources and nodes that they reach, of as many sources at once as have SEEN flags of nodes."""
    n = len(first) - 1
    many = max(1, SEEN // n)
    seen = np.zeros(min(many, max(len(sources), 1)) * n, bool)
    for i in range(0, len(sources), many):
        block = sources[i : i + many]
        row, at = np.arange(len(block)), block.astype(np.int64)
        out, size = [], 0
        while len(at):
            k, places = _out(first, at)
            key = np.repeat(row, k) * n + to[places]
            key = np.unique(key[~seen[key]])
            seen[key] = True
            row, at = np.divmod(key, n)
            out.append((block[row], at.astype(np.int32)))
            size += len(at)
            if size >= PAIRS_A_BATCH or not len(at):
                yield np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
                out, size = [], 0
        seen[:] = False


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a temporary one only in local mode, where there is but one machine."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loupe-"))
    return df.checkpoint()


def scc(edges_: DataFrame, most_rounds: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): strongly connected components of two or more nodes, by the least node.

    At most one_task edges, as counted, are worked on in one task by depth-first search,
    after what is on no cycle; module graphs mostly are that small. More go in rounds, and so does what is left of
    them, until it is that small; both give the same. In a round, nodes that nothing leads to or that lead nowhere are trimmed first.
    Then each node gets the least label that reaches it, and edges between labels, which
    can't be in a component, go. The nodes that reach their label's owner within one
    label form its component, of all labels at once; the rest goes on. Several steps are
    taken between checkpoints. RuntimeError if the rounds don't suffice.
    """
    ship(edges_.sparkSession)
    e = _cut(edges_.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    found = []
    for _ in range(most_rounds):
        if e.count() > one_task:
            e = _trimmed(e)
        n = e.count()
        if n <= one_task:
            if n:
                kind = e.schema["src"].dataType.simpleString()
                found.append(e.repartition(1).mapInArrow(_search, f"node {kind}, component {kind}"))
            break
        nodes = e.select(F.col("src").alias("node")).distinct()
        color = _spread(nodes.withColumn("label", F.col("node")), e, "src", "dst")
        inner = e.join(color.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(color.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst").where("ls = ld")
        inner = _cut(inner.select("src", "dst"))
        # backwards from the owners, within one label: the greatest mark that is reached is 1
        marks = color.select("node", (F.when(F.col("node") == F.col("label"), 0).otherwise(1)).alias("label"))
        back = _spread(marks, inner, "dst", "src").where("label = 0").select("node")
        part = _cut(back.join(color, "node").select("node", F.col("label").alias("component")))
        found.append(part)
        e = _cut(inner.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    else:
        raise RuntimeError(f"components are left after {most_rounds} rounds")
    if not found:
        return e.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    all_ = reduce(DataFrame.unionByName, found)
    many = all_.groupBy("component").count().where("count > 1").select("component")
    return all_.join(many, "component", "left_semi").select("node", "component")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of two or more nodes among the edges of one task: what is on no cycle is peeled off from both sides, and Tarjan's depth-first search without recursion takes the rest."""
    if not (some := [b for b in batches if len(b)]):
        return
    t = pa.Table.from_batches(some)
    del some
    kind = t["src"].type
    nodes, src, dst = _coded(t)
    del t
    for _ in range(2):
        gone = np.zeros(len(nodes), bool)
        for x in _peeled(*_lists(src, dst, len(nodes)), len(nodes)):
            gone[x] = True
        keep = ~(gone[src] | gone[dst])
        src, dst = dst[keep], src[keep]  # the second time from where edges lead
    if not len(src):
        return
    left = np.unique(np.concatenate([src, dst]))
    nodes, src, dst = nodes[left], np.searchsorted(left, src), np.searchsorted(left, dst)
    first_, to_ = _lists(src, dst, len(nodes))
    to, first = array("i", to_.astype(np.int32).tobytes()), array("q", first_.tobytes())
    turn, low, on, lead = array("i", [-1]) * len(nodes), array("i", [0]) * len(nodes), bytearray(len(nodes)), array("i", [-1]) * len(nodes)
    stack: list[int] = []
    clock = 0
    for root in range(len(nodes)):
        if turn[root] >= 0:
            continue
        work = [(root, first[root])]
        while work:
            v, at = work.pop()
            if at == first[v]:
                turn[v] = low[v] = clock
                clock += 1
                stack.append(v)
                on[v] = True
            elif on[to[at - 1]]:
                low[v] = min(low[v], low[to[at - 1]])
            while at < first[v + 1]:
                u = to[at]
                at += 1
                if turn[u] < 0:
                    work += [(v, at), (u, first[u])]
                    break
                if on[u]:
                    low[v] = min(low[v], turn[u])
            else:
                if low[v] == turn[v]:
                    members = [stack.pop()]
                    while members[-1] != v:
                        members.append(stack.pop())
                    least = min(members) if len(members) > 1 else -1
                    for u in members:
                        on[u], lead[u] = False, least
    leads = np.frombuffer(lead, np.int32)
    in_one = np.flatnonzero(leads >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[in_one], kind), pa.array(nodes[leads[in_one]], kind)], ["node", "component"])


STEPS = 3


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing leads to or that lead nowhere, again and again."""
    n = e.count()
    while n:
        for _ in range(STEPS):
            e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        e = _cut(e)
        m = e.count()
        if m == n:
            break
        n = m
    return e


def _spread(labels: DataFrame, e: DataFrame, frm: str, to: str) -> DataFrame:
    """Labels go along edges until each node has the least that reaches it, STEPS edges between checkpoints."""
    now = _cut(labels)
    while True:
        new = now
        for _ in range(STEPS):
            got = e.join(new.withColumnRenamed("node", frm), frm).groupBy(F.col(to).alias("node")).agg(F.min("label").alias("got"))
            new = new.join(got, "node", "left").select("node", F.least("label", F.coalesce("got", "label")).alias("label"))
        new = _cut(new)
        if new.join(now.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new
        now = new


def cycles(components: DataFrame) -> DataFrame:
    """(component, modules sorted, n_modules, severity): two modules High, three or four Medium, more Low."""
    c = components.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("modules"), F.count("*").alias("n_modules"))
    return c.withColumn("severity", F.when(F.col("n_modules") == 2, "High").when(F.col("n_modules") <= 4, "Medium").otherwise("Low"))


def circular_findings(files: DataFrame, facts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """One finding for each module of a cycle, at its first import of another module of the cycle, which a strongly connected component always has."""
    mods = modules(files, config.get("root", ""))
    e = edges(imports(facts), mods, config.get("include_external", False))
    members = cycles(scc(e)).withColumn("node", F.explode("modules"))
    members = members.join(mods.withColumnRenamed("module_name", "node"), "node")
    inside = e.join(members.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(members.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst").where("cs = cd")
    members = members.join(inside.groupBy(F.col("src").alias("node")).agg(F.min("line").alias("line")), "node", "left")
    n = F.col("n_modules")
    chain = F.array_join(F.concat("modules", F.slice("modules", 1, 1)), " -> ")
    return findings(members, {
        "rule_id": "circular-import-detected", "category": "imports", "severity": F.col("severity"), "message": F.concat(F.lit("Circular import detected: "), chain), "file_path": F.col("file_path"),
        "line_number": F.coalesce("line", F.lit(1)), "suggestion": F.when(n == 2, "Move what both modules share into a third").otherwise(F.format_string("Restructure the %d modules of the cycle", n)),
        "tags": F.array(F.lit("circular-import"), F.concat(F.lit("cycle-length-"), n.cast("string"))),
    })


def fan_in(edges_: DataFrame) -> DataFrame:
    """How many modules import each one."""
    return edges_.groupBy("dst").agg(F.countDistinct("src").alias("fan_in"))


def forbidden(edges_: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Edges that a layering rule forbids: (prefix that may not import, prefix that it may not)."""
    bad = reduce(lambda c, r: c | (F.col("src").startswith(r[0]) & F.col("dst").startswith(r[1])), rules, F.lit(False))
    return edges_.where(bad)
