"""Removal of repeated long byte strings with logarithmic index families of sparse suffix arrays.

A string of `length` bytes that occurs twice is found without indexing every suffix in one place.  The least k-mer
hash in a window of `length` bytes depends on the window's bytes alone, so equal windows have equal anchors, at the
same place in the window.  Runs of consecutive windows with one anchor are the units:

* Runs of equal bytes are counted by 128 bits, their anchor and a hash of their content: all windows of a run that is there twice recur.
* Of runs whose anchor has several contents, one run of each content is sent on with its bytes, dealt by anchor (a very
  frequent anchor also by the anchor's place in the window).  Each task keeps an index family over the suffixes (window
  starts) that it is sent: a new batch is sorted into a suffix array, merge-scanned against every level for matches of
  the whole length, and added as a level; levels of about one size are merged, so there are at most logarithmically
  many and each suffix is merged as often.

Suffixes are ordered by their first 24 bytes and then by a 64-bit hash of all `length` bytes; equal ones are compared
byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, release, select_as, slices
from .words import mixed

KMER = 32
#: Windows of one run at most; longer runs (periodic texts) are cut, so that a record's size is bounded.
LONGEST_RUN = 4096
#: An anchor with more contents than this is dealt by its place in the window as well, in ranges of SPLIT places.
HOT, SPLIT = 1000, 16


def string_hashes(raw: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each place, by doubling; shorter than raw by length - 1."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
    part = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed * 256 + 1))[raw]
    out, done, size, power = None, 0, 1, base
    while True:
        if length & size:
            if out is None:
                out = part
            else:
                n = len(raw) - done - size + 1
                out = out[:n] * power + part[done : done + n]
            done += size
        if done == length:
            return mixed(out)
        n = len(part) - size
        part = part[:n] * power + part[size : size + n]
        power = np.uint64(int(power) ** 2 % 2**64)
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(offsets: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor hash, the anchor's place behind the first window) of the runs of
    all texts; windows count from raw's begin."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, np.zeros(0, np.uint64), none
    hashes = string_hashes(raw, KMER, 1)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(32)
    anchor = (sliding_min((hashes >> low << low) | place, length - KMER + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= offsets[text + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(anchor)))
    keep = whole[first]
    first, size = first[keep], size[keep]
    parts = -(-size // LONGEST_RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    own = anchor[np.repeat(first, parts)]
    first, size = np.repeat(first, parts) + nth * LONGEST_RUN, np.minimum(np.repeat(size, parts) - nth * LONGEST_RUN, LONGEST_RUN)
    return text[first], first, size, hashes[own], own - first


def content_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte strings raw[first:end]."""
    base = 0xA0761D6478BD642F
    of_byte = mixed(np.arange(256, dtype=np.uint64) + np.uint64(775))
    powers = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), x, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of_byte[raw] * powers(np.uint64(base))[:-1], dtype=np.uint64)])
    back = powers(np.uint64(pow(base, -1, 1 << 64)))
    return mixed((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))


class IndexFamily:
    """Levels of suffix arrays.  add() tells which windows of a batch match, now or later through matches()."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.used = 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys of distinct windows, their numbers
        self.at: list[np.ndarray] = []  # where the windows begin, by batch
        self.repeated: list[np.ndarray] = []
        self.size = 0

    def _words(self, at: np.ndarray, shift: int) -> np.ndarray:
        """The eight bytes `shift` behind each place, as numbers in the bytes' order."""
        return np.lib.stride_tricks.as_strided(self.bytes[:8].view(">u8"), (len(self.bytes) - 7,), (1,))[at + shift]

    def _verify(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 1 << 18):
            x, y = a[i : i + (1 << 18)], b[i : i + (1 << 18)]
            for shift in [*range(0, self.length - 8, 8), self.length - 8]:
                if (self._words(x, shift) != self._words(y, shift)).any():
                    raise RuntimeError("different strings share 24 bytes and a 64-bit hash: choose another seed")

    def add(self, raw: np.ndarray, windows: np.ndarray) -> None:
        """A batch of windows that begin at these places of raw, numbered on from the last batch's."""
        if not len(windows):
            return
        while self.used + len(raw) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.used : self.used + len(raw)] = raw
        at = windows + self.used
        self.used += len(raw)
        key = np.empty((len(at), 4), ">u8")
        for c in range(3):
            key[:, c] = self._words(at, 8 * c)
        key[:, 3] = string_hashes(raw, self.length, 2)[windows]
        key = key.view("S32")[:, 0]
        order = np.argsort(key, kind="stable")
        suffixes, number = key[order], order + self.size
        self.at.append(at)
        every = np.concatenate(self.at) if len(self.at) > 1 else at
        self.at = [every]
        self.size += len(at)
        same = suffixes[1:] == suffixes[:-1]
        self._verify(every[number[1:][same]], every[number[:-1][same]])
        hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        for level, owner in self.levels:
            a = np.minimum(np.searchsorted(level, suffixes, "left"), len(level) - 1)
            found = level[a] == suffixes
            self._verify(every[number[found]], every[owner[a[found]]])
            hit |= found
            # One entry of the level stands for all that equal it: those were marked when they met.
            self.repeated.append(owner[a[found]])
        self.repeated.append(number[hit])
        # A level keeps one entry for each distinct window.
        distinct = np.concatenate([[True], ~same])
        self.levels.append((suffixes[distinct], number[distinct]))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            place = np.searchsorted(b, a, "left")
            new = b[np.minimum(place, len(b) - 1)] != a
            self.levels.append((np.insert(b, place[new], a[new]), np.insert(y, place[new], x[new])))

    def matches(self) -> np.ndarray:
        out = np.zeros(self.size, bool)
        for x in self.repeated:
            out[x] = True
        return out


def _spans(flags: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """[begin, end) of the bytes covered by flagged windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        yield a, b - 1 + length


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_text: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and with keep_text kept_text.

    Every byte that lies in a string of `length` bytes which also starts anywhere else in the corpus, in the same text
    or another, is removed; strings are judged on the input.  spans are the maximal removed runs as [begin, end) byte
    pairs; kept_text is the rest decoded as UTF-8 (a cut character becomes U+FFFD).  Null text counts as empty; texts
    shorter than `length` stay whole; repeated rows repeat each other's strings; no rows give no rows.  Windows
    that match are compared byte by byte, whole runs by 128-bit hashes.

    The scan makes one row for each run (about one in 85 bytes); they are counted by content and by anchor, with partial
    counts before each shuffle, and those that recur in any way are listed by text.  Only for runs whose anchor has
    several contents are bytes sent on, of one run for each content.  Texts are dealt once by (id, hash of text) and
    that shuffle serves both passes over them; a row is known by 96 bits of hashes of its id and text.
    """
    if length <= KMER:
        raise ValueError(f"length must be over {KMER}")
    rows = select_as(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text")).withColumn("more", F.hash(F.lit("more"), "text", "doc_id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            for i, j in slices(offsets):
                own = raw[offsets[i] : offsets[j]]
                text, first, size, anchor, place = runs(offsets[i : j + 1] - offsets[i], own, length)
                content = content_hashes(own, first, first + size + (length - 1))
                start = first - (offsets[i:j][text] - offsets[i])
                take = pa.array(text + i)
                columns = [*(batch.column(c).take(take) for c in (1, 2)), *(pa.array(x.view(np.int64)) for x in (anchor, content)), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(place, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["more", "hash", "anchor", "content", "start", "size", "place"])
        release()

    found = rows.select("text", "more", "hash").mapInArrow(scan, "more int, hash long, anchor long, content long, start int, size int, place int").where("anchor IS NOT NULL AND content IS NOT NULL")
    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min("hash").alias("least"))
    # The conditions that always hold keep both uses of the counts alike, so that one scan and shuffle serves them.
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("n").alias("_n"), F.count("least").alias("_least")).where("kinds > 1 AND _n > 0 AND _least > 0").select("anchor", "kinds")
    listed = contents.join(kinds, "anchor", "left").where("n > 1 OR kinds > 1").select("anchor", "content", (F.col("n") > 1).alias("whole"), F.coalesce("kinds", F.lit(0)).alias("kinds"), "least")
    # Of a content the runs of one text are sent on: what they match tells of all, or all are known to recur.
    listed = found.join(listed, ["anchor", "content"])
    way = F.when((F.col("kinds") > 1) & (F.col("hash") == F.col("least")), F.when(F.col("kinds") > HOT, 2).otherwise(1)).otherwise(0)
    listed = listed.withColumn("send", way.cast("byte")).select("more", "hash", F.struct(F.when(F.col("send") > 0, F.col("anchor")).alias("anchor"), "start", "size", "place", "whole", "send").alias("run"))
    of_text = listed.groupBy("hash", "more").agg(F.collect_list("run").alias("runs"))
    dealt = rows.repartition("hash", "more")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            listed = batch.column(3)
            at, fields = listed.offsets.to_numpy(), listed.values.flatten()
            anchor, start, size, place, whole, sent = (f.to_numpy(zero_copy_only=False) for f in fields)
            row, out = [], [[], [], [], [], []]
            for k in range(batch.num_rows):
                own = np.arange(at[k], at[k + 1])
                known = own[whole[own]]
                if len(known):  # runs known to recur go straight to the spans, joined where they meet
                    begins = np.sort(start[known])
                    stops = np.maximum.accumulate((start[known] + size[known])[np.argsort(start[known], kind="stable")] + length - 1)
                    new = np.flatnonzero(np.concatenate([[True], begins[1:] > stops[:-1]]))
                    for a, b in zip(begins[new].tolist(), stops[np.append(new[1:], len(stops)) - 1].tolist(), strict=True):
                        row.append(k)
                        for column, value in zip(out, (None, 0, a, b, None), strict=True):
                            column.append(value)
                for r in own[sent[own] > 0].tolist():
                    pieces = [(0, int(size[r]))]
                    if sent[r] == 2:  # pieces in which the anchor's place falls in one range of SPLIT
                        cuts = sorted({0, int(size[r]), *(c for c in range(int(place[r]) % SPLIT + 1, int(size[r]), SPLIT))})
                        pieces = list(zip(cuts, cuts[1:], strict=False))
                    for a, b in pieces:
                        begin = int(start[r]) + a
                        row.append(k)
                        part = (int(place[r]) - a) // SPLIT + 1 if sent[r] == 2 else 0
                        for column, value in zip(out, (anchor[r], part, begin, None, raw[offsets[k] + begin : offsets[k] + begin + b - a + length - 1].tobytes()), strict=True):
                            column.append(value)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(take), batch.column(1).take(take), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["more", "hash", "anchor", "part", "begin", "end", "content"])
        release()

    # Both passes over the dealt texts read the same columns, so that one shuffle serves them.
    sent = dealt.join(of_text, ["hash", "more"]).select("text", "hash", "more", "runs", "doc_id").mapInArrow(send, "more int, hash long, anchor long, part int, begin long, end long, content binary")
    # The runs that are known to recur pass the search; they have no bytes, and are dealt by their text.
    sent = sent.repartition(F.coalesce("anchor", "hash"), "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = IndexFamily(length)
        names = ["more", "hash", "begin", "end"]
        owners: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        sizes: list[np.ndarray] = []
        for batch in batches:
            done = batch.filter(batch.column(4).is_valid())
            yield pa.RecordBatch.from_arrays([done.column(c) for c in (0, 1, 3, 4)], names)
            batch = batch.filter(batch.column(5).is_valid())
            offsets, raw = buffers(batch.column(5))
            for i, j in slices(offsets):
                at, n = offsets[i:j] - offsets[i], np.diff(offsets[i : j + 1]) - length + 1
                every = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                family.add(raw[offsets[i] : offsets[j]], every)
                sizes.append(n)
            if batch.num_rows:
                owners.append((batch.column(0), batch.column(1), batch.column(3).to_numpy()))
        if not owners:
            return
        hit = family.matches()
        n = np.concatenate(sizes)
        ends = np.cumsum(n)
        ids, hashes = (pa.chunked_array([o[c] for o in owners]).combine_chunks() for c in (0, 1))
        begin = np.concatenate([o[2] for o in owners])
        record, starts, stops = [], [], []
        for k in np.flatnonzero(np.add.reduceat(hit, ends - n)).tolist():
            for a, b in _spans(hit[ends[k] - n[k] : ends[k]], length):
                record.append(k)
                starts.append(int(begin[k]) + a)
                stops.append(int(begin[k]) + b)
        take = pa.array(record, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(take), hashes.take(take), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names)
        release()

    spans = sent.select("more", "hash", "anchor", "begin", "end", "content").mapInArrow(search, "more int, hash long, begin long, end long")
    spans = spans.groupBy("hash", "more").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    text_col_type = ", kept_text string" if keep_text else ""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[tuple] = []
            for text, found in zip(texts, batch.column(2).to_pylist(), strict=True):
                blob = (text or "").encode()
                merged: list[list[int]] = []
                for s in found or ():
                    if merged and s["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["begin"], s["end"]])
                kept, last = [], 0
                for a, b in merged:
                    kept.append(blob[last:a])
                    last = b
                rest = b"".join([*kept, blob[last:]])
                out.append((len(blob), len(blob) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), merged, rest))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [batch.column(0), *(pa.array(cols[c], pa.int64()) for c in range(3)), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))]
            if keep_text:
                arrays.append(pa.array([r.decode("utf-8", "replace") for r in cols[5]], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept_text"] if keep_text else [])])

    return dealt.join(spans, ["hash", "more"], "left").select("doc_id", "text", "spans", "hash", "more").mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>{text_col_type}")
