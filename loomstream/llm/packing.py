"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_fst import default_tokenizer_path, transducer
from .common import buffers, checkpoint, make_room, release, select_as, slices

#: Bytes of text that are encoded at once: a step needs some 50 times as much.
STEP = 1 << 18


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, row (a hash of the row's id and text).

    A document is its ids and then end_id.  Only documents longer than capacity are cut; all pieces but the first are
    of capacity tokens.  Null text counts as empty: one piece of one token.
    """
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            rows: list[int] = []
            out: list[list[int]] = [[], [], [], []]
            for i, j in slices(offsets, STEP):
                at, ids = machine.encode(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]])
                for k in range(i, j):
                    own = np.append(ids[at[k - i] : at[k - i + 1]], np.uint32(end_id)).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    starts = [0, *range(first, len(own), capacity)]
                    for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)):
                        rows.append(k)
                        for column, value in zip(out, (p, a, b - a, zlib.crc32(own[a:b].tobytes())), strict=True):
                            column.append(value)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:]), batch.column(2).take(take)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])
        release()

    rows = select_as(docs, doc_id=id_col, text=text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, row long")


class Bins:
    """Bins of items by length.  All that the search needs to know of an item is its length, so items of a length are
    exchanged freely: a bin is a list of lengths, and which item of a length goes where is settled at the end."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, lengths: np.ndarray) -> None:
        """Best-fit decreasing: each item goes where it leaves the least room."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r is set when some bin has room r
        for x in np.sort(lengths)[::-1].tolist():
            fits = rooms >> x
            if fits:
                room = x + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(x)
            self.fill[b] += x
            by_room[room - x].append(b)
            rooms |= 1 << (room - x)

    def improve(self) -> None:
        """Exchange one for one, two for one, or move items between underfull bins while the sum of squared fills grows.

        Bins are taken from the emptiest up, and each tries to give away its items: an item moves to the bin with the
        least room that holds it, or replaces a shorter item of a fuller bin, or two items replace one, always the
        exchange that fills the other bin furthest.  Every exchange takes from the emptier of the two bins, so the sum
        of squares grows with each and the search ends.  A bin that becomes empty is dropped.  Looked up by length,
        an exchange costs at most capacity steps, however many bins there are.
        """
        total = sum(self.fill)
        least = -(-total // self.capacity)
        open_bins = {b for b, f in enumerate(self.fill) if f < self.capacity}
        # reach[y][r]: bins that hold an item of length y and have room r.
        reach: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        rooms: dict[int, set[int]] = defaultdict(set)

        def enter(b: int) -> None:
            room = self.capacity - self.fill[b]
            if room:
                rooms[room].add(b)
                for y in set(self.items[b]):
                    reach[y][room].add(b)

        def leave(b: int) -> None:
            room = self.capacity - self.fill[b]
            if room:
                rooms[room].discard(b)
                if not rooms[room]:
                    del rooms[room]
                for y in set(self.items[b]):
                    of = reach[y][room]
                    of.discard(b)
                    if not of:
                        del reach[y][room]

        for b in open_bins:
            enter(b)
        live = sum(1 for f in self.fill if f)
        for a in sorted(open_bins, key=lambda b: (self.fill[b], b)):
            if live <= least:
                break
            if not self.items[a] or self.fill[a] == self.capacity:
                continue
            leave(a)
            moved = True
            while moved and self.items[a]:
                moved = False
                own = sorted(set(self.items[a]))
                twos = [(x, z) for i, x in enumerate(own) for z in own[i:] if x < z or self.items[a].count(x) > 1]
                for give in sorted([*((x,) for x in own), *twos], key=sum, reverse=True):
                    found = self._target(sum(give), len(give), self.fill[a], rooms, reach)
                    if found is None:
                        continue
                    b, take = found
                    leave(b)
                    for x in give:
                        self.items[a].remove(x)
                        self.items[b].append(x)
                    if take:
                        self.items[b].remove(take)
                        self.items[a].append(take)
                    self.fill[a] += take - sum(give)
                    self.fill[b] += sum(give) - take
                    enter(b)
                    moved = True
                    break
            if self.items[a]:
                enter(a)
            else:
                live -= 1

    def _target(self, size: int, n: int, fill: int, rooms: dict, reach: dict) -> tuple[int, int] | None:
        """The bin, and the length it gives back (0: none), that size tokens from a bin of that fill go to best."""
        fits = [r for r in rooms if r >= size and self.capacity - r + size > fill]
        if fits:
            return next(iter(rooms[min(fits)])), 0
        best = None
        for y, by_room in reach.items():
            if y >= size:
                continue
            for r in by_room:
                # The other bin must end fuller than this one was, and be the fuller one now.
                if size - y <= r and self.capacity - r >= fill and (best is None or r - (size - y) < best[0]):
                    best = (r - (size - y), y, r)
        return None if best is None else (next(iter(reach[best[1]][best[2]])), best[1])


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item."""
    bins = Bins(capacity)
    bins.best_fit(lengths)
    bins.improve()
    of: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(lengths.tolist()):
        of[x].append(i)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for items in bins.items:
        at = 0
        for x in items:
            i = of[x].pop()
            number[i], offset[i] = used, at
            at += x
        used += bool(items)
    return number, offset


def best_fit_pack(items: DataFrame, *, capacity: int = 2048, group_rows: int = 50_000) -> DataFrame:
    """items with sequence_id long and offset long; items must have length (1 to capacity) and row.

    Rows are dealt by hash into groups of about group_rows, each packed by one task, so a hot source or document is
    spread over all groups and a task holds a bounded number of lengths.  Then the sequences that are at most half
    full are packed again in fewer groups, round by round until one group is left, so that cutting the input in
    groups costs no more than a sequence.  No rows give no rows; ties and repeated rows are items like any other.
    """
    items = checkpoint(items.withColumn("_deal", F.xxhash64("row", "piece", "start", F.rand(17))))
    count = items.count()
    groups = max(1, -(-count // group_rows))
    names = [c for c in items.columns if c != "_deal"]

    def pack(level: int):
        def run(table: pa.Table) -> pa.Table:
            make_room()
            number, offset = pack_lengths(table["length"].to_numpy(), capacity)
            fills = np.bincount(number, table["length"].to_numpy()).astype(np.int64)
            group = table["_group"].to_numpy().astype(np.int64)
            at = table.column_names.index("_group")
            table = table.remove_column(at)
            return table.append_column("sequence_id", pa.array((level << 56) | (group << 24) | number)).append_column("offset", pa.array(offset)).append_column("_fill", pa.array(fills[number]))

        return run

    done = []
    level = 0
    rest = items
    while True:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, _fill long"
        packed = rest.withColumn("_group", F.pmod("_deal", F.lit(groups))).groupBy("_group").applyInArrow(pack(level), schema)
        if groups == 1:
            done.append(packed)
            break
        packed = checkpoint(packed)
        done.append(packed.where(F.col("_fill") * 2 > capacity))
        rest = packed.where(F.col("_fill") * 2 <= capacity).select(*items.columns)
        groups = min(groups // 2, -(-rest.count() // group_rows)) or 1
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  See pieces, best_fit_pack."""
    cut = pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, tokenizer_path=tokenizer_path)
    return best_fit_pack(cut, capacity=capacity).drop("row")
