"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

The state of a LineIndex is three tables in the shared folder: where each line
stands (occurrences), how many times and where first (refs), and one cuckoo
filter a shard of refs, shards being ranges of the lines' hashes. A new batch
asks the filters first, so that only lines that may be known are joined with the
exact table, and the filters gain the others; deleting documents lowers the counts,
moves the first places on and takes lines that are left nowhere out of the filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import textvec as V
from loupe.llm.common import materialize, read, small_batches, unused

SLOTS = 4
MOST_PARTS = 8
NO_ID = (1 << 63) - 1
_FILTER = "shard int, n long, filter binary"


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints, four a bucket; whole arrays are inserted, asked and deleted at once."""

    def __init__(self, n: int = 0, slots: np.ndarray | None = None):
        if slots is None:
            slots = np.zeros((1 << max(1, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8)))) if n else 1), SLOTS), np.uint16)
        self.slots = slots

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        return cls(slots=np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = V.mix(keys.astype(np.int64).view(np.uint64))
        fp = (k >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (k & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return fp, one, self._other(fp, one)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (V.mix(fp.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(keys)
        return ((self.slots[one] == fp[:, None]) | (self.slots[two] == fp[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """A fingerprint for each key, also for one that is in it. A full table raises OverflowError and is then no longer valid: build a larger one."""
        fp, one, two = self._places(keys)
        rng = np.random.default_rng(len(keys))
        at = one
        for turn in range(600):
            if not len(fp):
                return
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            empty = self.slots[at] == 0
            placed = rank < empty.sum(1)
            nth = np.cumsum(empty, 1) - 1
            slot = np.argmax(empty & (nth == rank[:, None]), 1)
            self.slots[at[placed], slot[placed]] = fp[placed]
            fp, at = fp[~placed], at[~placed]
            if turn % 2 == 0 or not len(fp):
                at = self._other(fp, at)
                continue
            first = np.r_[True, at[1:] != at[:-1]]  # one eviction a bucket in a turn
            victim = rng.integers(0, SLOTS, int(first.sum()))
            out = self.slots[at[first], victim].copy()
            self.slots[at[first], victim] = fp[first]
            fp[first] = out
            at = np.where(first, self._other(fp, at), at)
        raise OverflowError("cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        """Keys that are in it; each takes one fingerprint out, so that a key that stands twice loses one."""
        fp, one, two = self._places(keys)
        flat = self.slots.reshape(-1)
        while len(fp):
            a = self.slots[one] == fp[:, None]
            b = self.slots[two] == fp[:, None]
            first = a.any(1)
            slot = np.where(first, one, two) * SLOTS + np.where(first[:, None], a, b).argmax(1)
            there = np.flatnonzero(first | b.any(1))
            _, once = np.unique(slot[there], return_index=True)  # one key a slot in a turn
            done = there[once]
            flat[slot[done]] = 0
            left = np.setdiff1d(there, done, assume_unique=True)
            fp, one, two = fp[left], one[left], two[left]

    @classmethod
    def build(cls, keys: np.ndarray) -> Cuckoo:
        n = max(len(keys), 8)
        while True:
            c = cls(n)
            try:
                c.insert(keys)
                return c
            except OverflowError:
                n *= 2


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """A document's place in the order, nulls last, and a hash of its text, to tell rows of one doc_id apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")


def occurrences(docs: DataFrame) -> DataFrame:
    """(did, th, pos, h1, h2) of every line that is not blank."""
    did, th = _keys(docs)
    lines = docs.select(did.alias("did"), th.alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("did", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _refs(occ: DataFrame) -> DataFrame:
    return occ.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min(F.struct("did", "th", "pos")).alias("first"))


def _shard(n: int) -> Column:
    return F.pmod(F.shiftright("h1", 20), F.lit(n)).cast("int")


def _build_filter(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "n": [len(pdf)], "filter": [Cuckoo.build(pdf["h1"].to_numpy()).dump()]})


def _probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    maybe = np.zeros(len(left), bool) if not len(right) else Cuckoo.load(right["filter"].iloc[0]).contains(left["h1"].to_numpy())
    return pd.DataFrame({"h1": left["h1"], "h2": left["h2"], "maybe": maybe})


def _put_in(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with more lines; null if they don't fit, so that it must be built anew."""
    n = len(left) + (int(right["n"].iloc[0]) if len(right) else 0)
    try:
        if len(right):
            c = Cuckoo.load(right["filter"].iloc[0])
            if n > c.slots.size * 0.9:
                raise OverflowError
            c.insert(left["h1"].to_numpy())
        else:
            c = Cuckoo.build(left["h1"].to_numpy())
        blob = c.dump()
    except OverflowError:
        blob = None
    return pd.DataFrame({"shard": [left["shard"].iloc[0]], "n": [n], "filter": [blob]})


def _take_out(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(right):
        return pd.DataFrame({"shard": [], "n": [], "filter": []})
    c = Cuckoo.load(right["filter"].iloc[0])
    c.delete(left["h1"].to_numpy())
    return pd.DataFrame({"shard": right["shard"], "n": right["n"] - len(left), "filter": [c.dump()]})


@dataclass
class LineIndex:
    """An immutable state: insert and delete give the next one.

    refs are kept as parts, one of each insert, which are added up when they are
    read: an insert writes its own lines and the filters of the shards that gain
    some, and nothing else. With more than MOST_PARTS parts they are written as one.
    A delete writes occ and refs anew. A shard whose filter is full, or all if
    shards have grown to four times lines_per_shard, is built anew from refs.
    """

    occ: DataFrame | None = None
    parts: tuple[DataFrame, ...] = ()
    filters: DataFrame | None = None
    shards: int = 1

    lines_per_shard = 200_000

    @property
    def refs(self) -> DataFrame:
        """(h1, h2, refs, first) of every line."""
        if len(self.parts) == 1:
            return self.parts[0]
        return reduce(DataFrame.unionByName, self.parts).groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.min("first").alias("first"))

    def probe(self, keys: DataFrame) -> DataFrame:
        """(h1, h2, maybe) for keys (h1, h2): false only for lines that the index doesn't hold."""
        k = keys.select("h1", "h2", _shard(self.shards).alias("shard"))
        return k.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, "h1 long, h2 long, maybe boolean")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs as well; ValueError if it holds a document of one of their ids already. Rows without a doc_id can't be told apart, are always taken, and can't be deleted."""
        small_batches(docs.sparkSession)
        new = materialize(occurrences(docs), "occ")
        if self.occ is not None and not new.where(F.col("did") != NO_ID).select("did").distinct().join(self.occ.select("did"), "did", "left_semi").isEmpty():
            raise ValueError("documents that are in the index are to be deleted before they are inserted again")
        fresh = materialize(_refs(new), "refs")
        if self.occ is None:
            return LineIndex(new, (fresh,), *self._filters(fresh))
        asked = materialize(self.probe(fresh), "probe")
        maybe = asked.where("maybe").select("h1", "h2")
        known = reduce(DataFrame.unionByName, [p.select("h1", "h2") for p in self.parts]).join(maybe, ["h1", "h2"], "left_semi").distinct()
        more = asked.where("not maybe").select("h1", "h2").unionByName(maybe.join(known, ["h1", "h2"], "left_anti"))
        parts = (*self.parts, fresh)
        state = LineIndex(self.occ.unionByName(new), parts, self.filters, self.shards)
        if len(parts) > MOST_PARTS:
            state.parts = (materialize(state.refs, "refs"),)
        state.filters = state._grown(more.select("h1", _shard(self.shards).alias("shard")))
        if not state.filters.where(F.col("n") > 4 * self.lines_per_shard).isEmpty():
            state.filters, state.shards = state._filters(state.refs)
        return state

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index as if the documents of doc_ids (doc_id) had never been inserted; unknown ones change nothing."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("did")).where("did is not null").distinct()
        touched = materialize(self.occ.join(gone, "did", "left_semi").select("h1", "h2").distinct(), "touched")
        occ = materialize(self.occ.join(gone, "did", "left_anti"), "occ")
        left = materialize(_refs(occ.join(touched, ["h1", "h2"], "left_semi")), "left")
        refs = materialize(self.refs.join(touched, ["h1", "h2"], "left_anti").unionByName(left), "refs")
        lost = touched.join(left, ["h1", "h2"], "left_anti").withColumn("shard", _shard(self.shards))
        hit = lost.select("shard").distinct()
        out = lost.groupBy("shard").cogroup(self.filters.join(hit, "shard", "left_semi").groupBy("shard")).applyInPandas(_take_out, _FILTER)
        filters = materialize(self.filters.join(hit, "shard", "left_anti").unionByName(out), "filters")
        return LineIndex(occ, (refs,), filters, self.shards)

    def _grown(self, more: DataFrame) -> DataFrame:
        """The filters with more lines (h1, shard)."""
        more = materialize(more, "more")
        hit = more.select("shard").distinct()
        out = more.groupBy("shard").cogroup(self.filters.join(hit, "shard", "left_semi").groupBy("shard")).applyInPandas(_put_in, _FILTER)
        filters = materialize(self.filters.join(hit, "shard", "left_anti").unionByName(out), "filters")
        full = filters.where("filter is null").select("shard")
        if full.isEmpty():
            return filters
        anew = self.refs.select("h1", _shard(self.shards).alias("shard")).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build_filter, _FILTER)
        return materialize(filters.where("filter is not null").unionByName(anew), "filters")

    def _filters(self, refs: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-refs.count() // self.lines_per_shard))
        return materialize(refs.select("h1", _shard(n).alias("shard")).groupBy("shard").applyInPandas(_build_filter, _FILTER), "filters"), n

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs, all of them in the index, without the lines that stand earlier in the index, and with n_lines and n_dropped.

        Earlier is by doc_id (null last), then a hash of the text, then the place in
        the text. Blank lines stay. A null text stays null with 0 lines. Repeated rows
        (one doc_id and text) count as one document, whose first places are kept in
        each. Columns n_lines and n_dropped get underscores if docs has such.
        """
        repeated = self.refs.where("refs > 1").select("h1", "h2", "first")
        drops = self.occ.join(repeated, ["h1", "h2"]).where(F.struct("did", "th", "pos") != F.col("first")).groupBy("did", "th").agg(F.collect_set("pos").alias("drop"))
        did, th, drop, n1, n2 = (unused(docs, c) for c in ("did", "th", "drop", "n_lines", "n_dropped"))
        a, b = _keys(docs)
        keyed = docs.withColumns({did: a, th: b})
        d = drops.select(F.col("did").alias(did), F.col("th").alias(th), F.col("drop").alias(drop)).hint("shuffle_hash")
        lines = F.split("text", "\n")
        kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n")
        j = keyed.join(d, [did, th], "left")
        return j.select(
            *[F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
            F.coalesce(F.size(lines), F.lit(0)).alias(n1),
            F.coalesce(F.size(drop), F.lit(0)).alias(n2),
        )


def _second() -> Column:
    """A quarter of the ids, by hash; rows without one are not in it."""
    return F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)


def dedup_lines(docs: DataFrame) -> tuple[DataFrame, LineIndex]:
    """All of docs through a new index in two batches: (docs without repeated lines and with n_lines and n_dropped, the index). See LineIndex.clean. A doc_id that is no number raises; an empty table gives an empty one."""
    second = _second()
    index = LineIndex().insert(docs.where(~second)).insert(docs.where(second))
    return index.clean(docs), index


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand earlier in the corpus; a quarter of the documents is deleted from the index and inserted again before."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, index = dedup_lines(docs)
    again = docs.where(_second())
    return index.delete(again.select("doc_id")).insert(again).clean(docs)


OP3_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents),
r as (select *, row_number() over (partition by line order by doc_id, pos) rn from l),
k as (select doc_id, string_agg(line, chr(10) order by pos) filter (where rn = 1 or trim(line) = '') text,
             count(*) n_lines, count(*) filter (where rn > 1 and trim(line) <> '') n_dropped from r group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end text,
       coalesce(k.n_lines, 0)::int n_lines, coalesce(k.n_dropped, 0)::int n_dropped
from documents d left join k on k.doc_id = d.doc_id
"""
