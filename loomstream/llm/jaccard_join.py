"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

Jaccard distance d is a metric.  A corpus is sparse in it: nearly all pairs share nothing and lie at distance 1, so a
few pivots would leave all documents equally far and every window open.  Pivots are therefore taken where documents
are:

* For a document x and radius r let Q be any floor(r |x|) + 1 of its shingles.  d(x, Q) = 1 - |Q| / |x| < 1 - r, so
  by the triangle inequality every y within r of x has d(y, Q) < 1: it shares a shingle with Q.  With one order of all
  shingles for all documents (shingles that recur widely last) two documents within r share one among the first
  floor(r |x|) + 1 of each; documents that share such a shingle form a cell.
  Heads are a margin longer than that, so that linked documents share many of theirs, and documents that share but a
  passage with others, and so cannot be within r of any, leave their cells.
* Of each cell one document is the pivot, the same for all cells where it is least in a fixed order, so near copies
  agree on one.  A pivot's region is all documents of its cells: every linked pair meets in some region.
* In a region, members within r of the pivot are linked to it, and so to each other, without comparing them.  The rest
  is compared, exactly, with the members in its window |d(x, p) - d(y, p)| <= r.  Large regions recurse: members go to
  the Voronoi region of the nearest of several new pivots, and by the window d(y, q) <= d(y, nearest) + 2 r to those
  of other pivots that can hold a member within r of them.
* Regions too large for a task are cut in blocks, and each pair of blocks is a task.

Regions return links that span what they found linked, never all pairs; components are made of links by star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_ROWS, ascii_lower, buffers, checkpoint, distinct, make_room, release, select_as, slices
from .components import connected_components
from .words import MIX, mixed, texts_apart, word_hashes

#: Shingles whose sets one task of the region join holds at most (two blocks), and members that are compared directly.
BLOCK_SHINGLES, LEAF = 1_000_000, 64
#: How much longer heads are than the radius asks for, as a share of the set in percent.  It changes no result.
MARGIN = 10
#: Ids of sets that a task remembers having sent.
MOST_SEEN = 100_000
#: A shingle this frequent goes to the end of the order; at most so many (by 32 bits of their hash) are known to be.
#: Neither changes a result.
FREQUENT, MOST_FREQUENT = 2, 2_000_000
#: Bytes of texts whose sets are made at once.
SLICE = 1 << 20
#: Parts that a component's rows are dealt to, so that no component is one task's.
SALTS = 16


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's set of hashes of its n-word shingles, sorted; with fewer words the whole sequence, empty without."""
    apart = texts_apart(offsets, ascii_lower(raw))
    count = len(offsets) - 1
    start, _, words = word_hashes(apart)
    edges = np.searchsorted(start, offsets + np.arange(count + 1))
    long = words.copy()
    for k in range(1, n):
        long = mixed(long[: max(0, len(words) - k)] * MIX + words[k:])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= n:
            yield distinct(long[a : b - n + 1])
        elif b > a:
            h = words[a : a + 1]
            for k in range(1, b - a):
                h = mixed(h * MIX + words[a + k])
            yield mixed(h + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit id of a set, alike for equal sets."""
    if not len(shingles):
        return 0
    return int(mixed(np.add.reduce(mixed(shingles + MIX), keepdims=True) + np.uint64(len(shingles)))[0].astype(np.int64))


class Region:
    """Sets of one region (or two of its blocks) and an inverted index over them."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.sets, self.percent = ids, sets, percent
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.shingle, self.owner = flat[order], owner[order]
        self.parent = list(range(len(sets)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)

    def common(self, x: int) -> np.ndarray:
        """Shingles that each member shares with member x."""
        a, b = np.searchsorted(self.shingle, self.sets[x], "left"), np.searchsorted(self.shingle, self.sets[x], "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def distance(self, x: int, shared: np.ndarray) -> np.ndarray:
        return 1 - shared / (self.size + self.size[x] - shared)

    def near(self, x: int, shared: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (self.size + self.size[x] - shared)

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        """Link all pairs of members within the radius."""
        r = 1 - self.percent / 100 + 1e-9
        pivots = members[:: -(-len(members) // 8)] if len(members) > LEAF and depth < 8 else members[:0]
        if len(pivots):
            far = np.empty((len(pivots), len(members)))
            done = np.zeros(len(members), bool)
            for i, p in enumerate(pivots.tolist()):
                shared = self.common(p)
                far[i] = self.distance(p, shared)[members]
                near = members[self.near(p, shared)[members]]
                for y in near.tolist():
                    self.link(p, y)
                done |= members == p
            home = far.argmin(0)
            nearest = far[home, np.arange(len(members))]
            parts = [members[(far[i] <= nearest + 2 * r) & ~done] for i in range(len(pivots))]
            if max(map(len, parts)) <= 0.7 * len(members):
                for part in parts:
                    if len(part) > 1:
                        self.join(part, depth + 1)
                return
            if len({self.root(x) for x in members.tolist()}) == 1:
                return
        inside = np.zeros(len(self.sets), bool)
        inside[members] = True
        for x in members.tolist():
            inside[x] = False
            mine = self.root(x)
            for y in np.flatnonzero(inside & self.near(x, self.common(x))).tolist():
                if self.root(y) != mine:
                    self.link(x, y)
                    mine = self.root(x)

    def links(self, pivot: int, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that span the linked members.  first: members of the first block; pairs across blocks (or in the one
        block there is) are joined, but pairs in one block of two are left to that block's own task."""
        r = 1 - self.percent / 100 + 1e-9
        shared = self.common(pivot)
        delta = self.distance(pivot, shared)
        linked = self.near(pivot, shared)
        for y in np.flatnonzero(linked).tolist():
            self.link(pivot, y)
        rest = np.flatnonzero(~linked)
        if len(rest):
            # Members of the ball around the pivot are one already; the rest meets them only in its window.
            low, high = delta[rest].min() - r, delta[rest].max() + r
            window = np.flatnonzero((delta >= low) & (delta <= high))
            if first.all():
                if len(window) > LEAF or len(rest) == len(window):
                    self.join(window)
                else:
                    self._across(rest, window, delta, r)
            else:
                self._across(rest[first[rest]], window[~first[window]], delta, r)
                self._across(rest[~first[rest]], window[first[window]], delta, r)
        for x in range(len(self.sets)):
            if (y := self.root(x)) != x:
                yield int(self.ids[y]), int(self.ids[x])

    def _across(self, some: np.ndarray, others: np.ndarray, delta: np.ndarray, r: float) -> None:
        inside = np.zeros(len(self.sets), bool)
        inside[others] = True
        for x in some.tolist():
            for y in np.flatnonzero(inside & (np.abs(delta - delta[x]) <= r) & self.near(x, self.common(x))).tolist():
                self.link(x, y)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, component, set_id, text_hash (of the text as it is).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space.  A text's set is its distinct `words`-word
    shingles, the whole sequence if it has fewer words.  Two documents link when the shared shingles are at least
    `percent` of all shingles of the two; component_id is the smallest doc_id that links reach, the row's own included.
    Texts without words (null ones too) have an empty set and link with nothing.  Equal sets are one class with one
    set_id (0: empty), so copies are joined once and repeated rows share a component.  Null ids take part but are never
    a component's id unless all its ids are null; component (a set's id) tells components apart in any case.  No rows give no rows; further columns of docs are ignored.
    Shingles and sets are compared by 64-bit hashes.
    """
    rows = select_as(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row a text, and behind them a row for each shingle (32 bits of it) that recurs among the batch's texts.
        make_room()
        names = ["doc_id", "n_shingles", "set_id", "text_hash", "shingle"]
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            n, ids, low = [], [], []
            for i, j in slices(offsets, SLICE):
                for s in shingle_sets(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], words):
                    n.append(len(s))
                    ids.append(set_id(s))
                    low.append(s.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), batch.column(2), pa.nulls(len(n), pa.int64())], names)
            flat = np.concatenate(low) if low else np.zeros(0, np.uint32)
            low.clear()
            flat.sort()
            shingle, times = np.unique(flat[1:][flat[1:] == flat[:-1]].astype(np.int64), return_counts=True)
            del flat
            yield pa.RecordBatch.from_arrays([pa.nulls(len(times), batch.column(0).type), pa.array(times + 1, pa.int64()), pa.nulls(len(times), pa.int64()), pa.nulls(len(times), pa.int64()), pa.array(shingle)], names)
        release()

    first = checkpoint(rows.mapInArrow(read, f"doc_id {kind}, n_shingles long, set_id long, text_hash long, shingle long"))
    narrow = first.where("shingle IS NULL").drop("shingle")
    counted = first.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(counted.orderBy(F.desc("n"), "shingle").select("shingle").limit(MOST_FREQUENT).toArrow()["shingle"].to_numpy().astype(np.uint32)))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        seen: set[int] = set()
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            for i, j in slices(offsets, SLICE):
                heads, ids, sizes = [], [], []
                for s in shingle_sets(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], words):
                    own = set_id(s)
                    if not len(s) or own in seen:  # of copies in a task one sends its shingles
                        continue
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(own)
                    n = len(s)
                    # Linked sets share over MARGIN % of the smaller one's size among their heads (see `least`).
                    head = n * (100 - percent) // 100 + n * MARGIN // 100 + 1
                    if len(last):
                        low = s.astype(np.uint32)
                        common = last[np.minimum(np.searchsorted(last, low), len(last) - 1)] == low
                        s = np.concatenate([s[~common], s[common]])
                    heads.append(s[:head])
                    ids.append(np.full(len(heads[-1]), own))
                    sizes.append(np.full(len(heads[-1]), n, np.int32))
                if heads:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))], ["shingle", "set_id", "n"])
        release()

    # In a cell, by size, members meet only through a chain of sizes that a link can span.
    by_size = Window.partitionBy("shingle").orderBy("n")
    cells = rows.select("text").mapInArrow(postings, "shingle long, set_id long, n int")
    below = F.coalesce(100 * F.lag("n").over(by_size) >= percent * F.col("n"), F.lit(False))
    above = F.coalesce(100 * F.col("n") >= percent * F.lead("n").over(by_size), F.lit(False))
    cells = cells.withColumn("below", below).withColumn("above", above)
    cells = cells.withColumn("chain", F.sum(F.when(F.col("below"), 0).otherwise(1)).over(by_size.rowsBetween(Window.unboundedPreceding, 0))).where("below OR above")
    cell = Window.partitionBy("shingle", "chain")
    cells = cells.withColumn("pivot", F.min("set_id").over(cell)).withColumn("other", F.max("set_id").over(cell)).where("pivot <> other")
    shared = checkpoint(cells.groupBy("pivot", "set_id").agg(F.max("n").alias("n"), F.count("*").alias("cells")))
    # With heads longer by a margin l than the radius asks for, linked sets x and y share min(l(x), l(y)) + 1 shingles of
    # their heads, and |y| >= percent |x|: a set that shares fewer in all of its cells together has no link.
    least = F.floor(F.floor(F.col("n") * percent / 100) * MARGIN / 100) + 1
    viable = shared.groupBy("set_id").agg(F.max("n").alias("n"), F.sum("cells").alias("cells")).where(F.col("cells") >= least).select("set_id")
    shared = shared.join(viable, "set_id", "left_semi")
    # The least member left is its region's pivot; regions that now have one pivot are one.
    leading = shared.groupBy("pivot").agg(F.min("set_id").alias("lead"), F.max("set_id").alias("last")).where("lead <> last")
    members = checkpoint(shared.join(leading, "pivot").groupBy(F.col("lead").alias("pivot"), "set_id").agg(F.max("n").alias("n")))

    # The sets of all classes in regions, read from a document of each class.
    wanted = members.select(F.col("set_id").alias("wanted")).distinct()
    readers = narrow.where("n_shingles > 0").join(wanted, F.col("set_id") == F.col("wanted"), "left_semi").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("of"))
    readers = checkpoint(readers.select(F.col("set_id").alias("wanted_set"), F.col("of.doc_id").alias("reader")))
    readers = F.broadcast(readers) if readers.count() <= BROADCAST_ROWS else readers.hint("shuffle_hash")
    texts = rows.join(readers, rows["doc_id"].eqNullSafe(readers["reader"])).select("wanted_set", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            want = batch.column(0).to_pylist()
            found, out = [], []
            for i, j in slices(offsets, SLICE):
                for k, s in enumerate(shingle_sets(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], words), i):
                    if set_id(s) == want[k]:  # rows that share an id may have other texts
                        found.append(want[k])
                        out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(out, pa.binary())], ["set_id", "shingles"])

    shingles = texts.mapInArrow(sets, "set_id long, shingles binary")
    weights = members.groupBy("pivot").agg(F.sum("n").alias("weight")).select("pivot", F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # A region of one block is one task's group (0, 0); else each member meets every other block, and its own alone.
    dealt = members.join(weights, "pivot").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    is_pivot = F.col("pivot") == F.col("set_id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", "set_id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "blocks")
    leading = dealt.where(is_pivot).select("pivot", "set_id", "blocks").distinct()
    leading = leading.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)))
    dealt = dealt.where(~is_pivot).select("pivot", "i", "j", "own", "set_id").unionByName(leading.select("pivot", "i", "j", F.lit(-1).alias("own"), "set_id"))
    regions = dealt.join(shingles, "set_id").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "own")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        key, ids, owns, held = None, [], [], []

        def finish() -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(ids) > 1:
                uniq = {s: i for i, s in enumerate(ids)}
                rows_ = list(uniq.values())
                region = Region(np.array([ids[i] for i in rows_]), [held[i] for i in rows_], percent)
                own = np.array([owns[i] for i in rows_])
                first = np.ones(len(rows_), bool) if key[1] == key[2] else own != key[2]
                out = list(region.links(int(np.flatnonzero(region.ids == key[0])[0]), first))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            at, raw = buffers(batch.column(5))
            for r, (p, i, j, own, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if key != (p, i, j):
                    if key is not None:
                        yield finish()
                    key, ids, owns, held = (p, i, j), [], [], []
                ids.append(s)
                owns.append(own)
                held.append(raw[at[r] : at[r + 1]].view(np.uint64).copy())
        if key is not None:
            yield finish()

    links = regions.select("pivot", "i", "j", "own", "set_id", "shingles").mapInArrow(join, "a long, b long")
    component = checkpoint(connected_components(links).select(F.col("node").alias("set_id"), "component"))
    frequent.destroy()
    # A component's smallest document: by set first, and dealt to SALTS parts where it goes back to the sets.
    of_set = narrow.groupBy("set_id").agg(F.min("doc_id").alias("least"))
    of_component = of_set.join(component, "set_id").groupBy("component").agg(F.min("least").alias("component_id"))
    salted = of_component.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = component.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"]).select("set_id", "component", "component_id")
    # A set without links is its own component; copies share it.
    alone = of_set.join(component, "set_id", "left_anti")
    out = narrow.join(named.unionByName(alone.select("set_id", F.col("set_id").alias("component"), F.col("least").alias("component_id"))), "set_id", "left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "set_id", "text_hash")
