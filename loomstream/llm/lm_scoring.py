"""Language-model scores of texts: prediction by partial matching over byte contexts, and a unigram word model.

The PPM model reads bytes (A-Z lower-cased, so that the byte A is free to stand for a text's begin and end).  Its trie
holds the counts of every byte after every context of up to ORDER bytes in the training texts.  A path of ORDER + 1
bytes is a key of 48 bits; counts of shorter contexts are sums over keys.  The trie is kept whole, as a table dealt by
the last three bytes of the context: all that the probability of a key needs lies in one part (the orders up to SENT
are at most 231**3 counts and are sent to every task), where it is computed once for every key that the texts have.
Texts look up the most frequent keys in a table of bounded size that every task is sent; the others come by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, buffers, distinct, release, select_as, slices, written
from .words import texts_apart, word_hashes

#: Bytes of the longest contexts, and of those whose counts every task is sent.
ORDER, SENT = 5, 2
#: Stands for what is before and behind a text; texts do not hold it, as they are lower-cased.
END = 65
#: Bytes that can follow a context: all but the capitals, and END.
ALPHABET = 256 - 26 + 1
#: Distinct keys and words that a training task holds before it sends their counts on.
HELD_KEYS, HELD_WORDS = 1_500_000, 300_000
#: Bytes of texts that are read at once, and positions whose keys are made at once.
SLICE, STEP = 1 << 20, 1 << 19
#: Longer words are not sent to every task, however frequent they are.
LONGEST_HEAD = 512
SIGN = np.uint64(1 << 63)


def keys_of(offsets: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, texts' numbers), step by step: for each byte and each text's end the ORDER bytes before it and itself.
    low: lower-cased bytes."""
    lengths = np.diff(offsets)
    padded = np.full(len(low) + (ORDER + 1) * len(lengths) + 8, END, np.uint8)
    padded[np.arange(len(low)) + np.repeat(np.arange(len(lengths)) * (ORDER + 1) + ORDER, lengths)] = low
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + ORDER + 1)
    inside = np.ones(len(text), bool)  # all but the windows that reach into the next text
    last = np.cumsum(lengths + ORDER + 1)
    for k in range(1, ORDER + 1):
        inside[last - k] = False
    every = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(text),), (1,))
    for i in range(0, len(text), STEP):
        own = inside[i : i + STEP]
        yield (every[i : i + STEP][own].astype(np.uint64) >> np.uint64(16)).view(np.int64), text[i : i + STEP][own]


def key_log10(keys: np.ndarray, counts: np.ndarray, short: np.ndarray, short_counts: np.ndarray) -> np.ndarray:
    """log10 probability of each key's last byte after the bytes before it: from the longest context down, method C
    escapes (a context's new bytes weigh as many counts as it has seen distinct ones) with exclusion of what longer
    contexts hold; below order 0 the bytes left are equally likely.

    keys: distinct ones, among them all counted ones that share the last SENT + 1 bytes of their context; counts: 0
    for a key that was only met in held-out texts.  short: keys of order SENT and their counts over all training texts.
    """
    levels: list[tuple[np.ndarray, ...]] = []
    for order in range(ORDER + 1):
        all_keys, all_counts = (short, short_counts) if order <= SENT else (keys[counts > 0], counts[counts > 0])
        leaf, at = np.unique(all_keys & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        count = np.bincount(at, all_counts, len(leaf))
        lower = levels[-1][1][np.searchsorted(levels[-1][0], leaf & ((1 << 8 * order) - 1))] if order and len(leaf) else np.zeros(len(leaf))
        context, at = np.unique(leaf >> 8, return_inverse=True)
        # Of a context: counts, distinct bytes, and what these count in the next shorter context.
        levels.append((leaf, count, context, *(np.bincount(at, w, len(context)) for w in (count, np.ones(len(leaf)), lower))))
    out = np.zeros(len(keys))
    mass, number = np.zeros(len(keys)), np.zeros(len(keys))  # excluded from the order at hand
    left = np.arange(len(keys))
    for order in range(ORDER, -1, -1):
        leaf, count, context, total, distinct, lower = levels[order]
        if not len(leaf):
            continue
        own = keys[left] & ((1 << 8 * (order + 1)) - 1)
        find = lambda table, k: np.minimum(np.searchsorted(table, k), len(table) - 1)
        at, place = find(context, own >> 8), find(leaf, own)
        here, hit = context[at] == own >> 8, leaf[place] == own
        rest = np.where(here, total[at] - mass[left], 0.0)
        escape = np.where(distinct[at] < ALPHABET, distinct[at] - number[left], 0.0)
        out[left[hit]] += np.log10(count[place[hit]] / (rest + escape)[hit])
        miss = here & ~hit & (rest > 0)
        out[left[miss]] += np.log10(escape[miss] / (rest + escape)[miss])
        mass[left], number[left] = np.where(here, lower[at], 0.0), np.where(here, distinct[at], 0.0)
        left = left[~hit]
    out[left] -= np.log10(ALPHABET - number[left])
    return out


class Lookup:
    """Numbers of distinct non-negative keys by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.shift = np.uint64(64 - self.mask.bit_length())
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.place = np.zeros(self.mask + 1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # of keys that meet in a free slot the last written one has it, the others go on
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.place[slot] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not held."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.place[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            found = there == keys[left]
            out[left[found]] = self.place[slot[left[found]]]
            left = left[~found & (there >= 0)]
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, value) of the columns text and held: counts over the texts that are learned from, of keys (word is
    empty; keys of held-out texts count 0), of words (key: their hash with its sign set), and of texts (key: -1)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    words: dict[bytes, list[int]] = {}  # a word's count and key
    texts = 0

    def rows(key, word: list[bytes] | None, value) -> pa.RecordBatch:
        n = len(key)
        word = pa.array(word, pa.binary()) if word is not None else pa.array([b""], pa.binary()).take(pa.array(np.zeros(n, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), word, pa.array(value, pa.int64())], ["key", "word", "value"])

    def of_words() -> pa.RecordBatch:
        out = rows([k for _, k in words.values()], list(words), [c for c, _ in words.values()])
        words.clear()
        return out

    for batch in batches:
        offsets, raw = buffers(batch.column(0))
        learned = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        texts += int(learned.sum())
        for i, j in slices(offsets, SLICE):
            low, at = ascii_lower(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
            for keys, text in keys_of(at, low):
                own = learned[i:j][text]
                held.append(np.unique(keys[own], return_counts=True))
                if not own.all():
                    other = distinct(keys[~own])
                    held.append((other, np.zeros(len(other), np.int64)))
                if sum(len(k) for k, _ in held) > HELD_KEYS:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD_KEYS // 2:
                        key, value = held.pop()
                        yield rows(key, None, value)
            apart = texts_apart(at, low)
            start, stop, hashes = word_hashes(apart)
            of_text = np.searchsorted(at[1:] + np.arange(1, j - i + 1), start, "right")
            own = learned[i:j][of_text] if len(start) else np.zeros(0, bool)
            blob = apart.tobytes()
            word, first, n = np.unique(hashes[own], return_index=True, return_counts=True)
            for key, a, b, c in zip((word | SIGN).view(np.int64).tolist(), start[own][first].tolist(), stop[own][first].tolist(), n.tolist(), strict=True):
                of = words.get(w := blob[a:b])
                if of is None:
                    words[w] = [c, key]
                else:
                    of[0] += c
            if len(words) > HELD_WORDS:
                yield of_words()
    if held:
        key, value = _merged(held)
        yield rows(key, None, value)
    yield of_words()
    yield rows([-1], None, [texts])
    release()


def _key_scores(counted: DataFrame) -> DataFrame:
    """key, value, log_p of all keys of all texts: their counts, and log10 probabilities of their last bytes."""
    keys = counted.where("key >= 0").select("key", "value")
    low = keys.where("value > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (SENT + 1)) - 1)).alias("key")).agg(F.sum("value").alias("value"))
    table = low.toArrow()  # at most ALPHABET ** (SENT + 1) rows
    shared = counted.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["value"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            key, value = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(key_log10(key, value, *shared.value))], ["key", "value", "log_p"])
        release()

    # Contexts that end in the same SENT + 1 bytes meet in one part.
    ends = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (SENT + 1)) - 1))
    return keys.repartition(ends).mapInArrow(run, "key long, value long, log_p double")


def _head(table: DataFrame, most: int, *columns: str) -> tuple[pa.Table, Column]:
    """The most rows of highest value, and a test of table's other rows."""
    top = table.orderBy(F.desc("value"), "key").limit(most).select("key", "value", *columns).toArrow()
    if top.num_rows < most:
        return top, F.lit(False)
    if not most:
        return top, F.lit(True)
    key, value = top["key"][-1].as_py(), top["value"][-1].as_py()
    return top, (F.col("value") < F.lit(value)) | ((F.col("value") == F.lit(value)) & (F.col("key") > F.lit(key)))


def lm_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", head_keys: int = 1_000_000, head_words: int = 60_000) -> DataFrame:
    """One row a row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Both models learn from all rows but the held-out ones (null counts as not held out).  Words are maximal runs
    without ASCII white space after lower-casing A-Z, and each text ends in one end token.  base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens; score is the log10 probability that the PPM model gives the text's
    lower-cased bytes and its end.  Null text counts as empty; repeated rows count and are returned each; with nothing
    to learn from, base_score is 0 and bytes are equally likely.  No rows give no rows; further columns of docs are
    ignored; a text of any length is read in steps.

    All contexts and all words are counted, however many there are.  The head_keys most frequent keys and head_words most
    frequent words of the whole corpus (their numbers change no result) are looked up by broadcast; what a text holds
    of the others becomes a row for each distinct one, and is joined to the counts.  None of them is frequent, so no
    key of that join holds a large share of the rows.
    """
    rows = select_as(docs.withColumn("_held", F.coalesce(held_out, F.lit(False))), doc_id=id_col, text=text_col, held="_held")
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    counted = rows.select("text", "held").mapInArrow(_counts, "key long, word binary, value long")
    counted = written(counted.groupBy("key", "word").agg(F.sum("value").alias("value")))
    is_word = F.octet_length("word") > 0
    n_of = lambda test, c: F.coalesce(F.sum(F.when(test, c)), F.lit(0))
    n, v, ends = counted.agg(n_of(is_word, F.col("value")), n_of(is_word, F.lit(1)), n_of((F.col("key") == -1) & ~is_word, F.col("value"))).first()
    n, v = n + ends, v + (1 if ends else 0)
    keys = written(_key_scores(counted))
    top_keys, other_keys = _head(keys, head_keys, "log_p")
    known = counted.where(is_word)
    short = F.octet_length("word") <= LONGEST_HEAD
    top_words, other_words = _head(known.where(short), head_words)
    of_words = top_words["key"].to_numpy() & 0x7FFFFFFFFFFFFFFF
    shared = rows.sparkSession.sparkContext.broadcast((top_keys["key"].to_numpy(), top_keys["log_p"].to_numpy(), of_words, np.log10(top_words["value"].to_numpy() + 1.0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key, by_word = _tables(shared.value)
        log_of_key, log_of_word = (np.append(shared.value[c], 0.0) for c in (1, 3))  # what is not found (-1) adds 0

        def once(text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(first place, times) of each distinct pair."""
            order = np.lexsort((item, text))
            text, item = text[order], item[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
            return order[new], np.diff(np.append(new, len(text)))

        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            hashes = batch.column(3).to_numpy()
            for i, j in slices(offsets, SLICE):
                low, at = ascii_lower(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                ppm = np.zeros(j - i)
                rare: list[tuple[np.ndarray, np.ndarray]] = []
                for key, text in keys_of(at, low):
                    found = by_key.find(key)
                    ppm += np.bincount(text, log_of_key[found], j - i)
                    rare.append((text[found < 0], key[found < 0]))
                rare_text, rare_key = (np.concatenate([r[c] for r in rare]) for c in (0, 1)) if rare else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                first, key_times = once(rare_text, rare_key)
                rare_text, rare_key = rare_text[first], rare_key[first]
                apart = texts_apart(at, low)
                start, stop, word = word_hashes(apart)
                of_text = np.searchsorted(at[1:] + np.arange(1, j - i + 1), start, "right")
                found = by_word.find((word & ~SIGN).view(np.int64))
                total, hits = np.bincount(of_text, log_of_word[found], j - i), np.bincount(of_text[found >= 0], minlength=j - i)
                other = np.flatnonzero(found < 0)
                first, word_times = once(of_text[other], word[other])
                first = other[first]
                blob = apart.tobytes()
                # A row for each rare word and key of a text, and one for the text, whose key is its own.
                more = np.arange(j - i)
                take = pa.array(np.concatenate([of_text[first], rare_text, more]).astype(np.int64) + i)
                key = np.concatenate([(word[first] | SIGN).view(np.int64), rare_key, hashes[i:j] | np.int64(-(2**63))])
                others = len(first) + len(rare_key)
                nothing = pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(rare_key) + j - i, np.int64)))
                words = pa.concat_arrays([pa.array([blob[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)], pa.binary()), nothing])
                times = np.concatenate([word_times, key_times, np.zeros(j - i, np.int64)]).astype(np.int32)
                tokens = np.bincount(of_text, minlength=j - i) + 1
                facts = [pa.concat_arrays([pa.nulls(others, t), pa.array(x, t)]) for x, t in ((tokens, pa.int64()), (hits, pa.int64()), (total, pa.float64()), (ppm, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 2, 3)), pa.array(key), words, pa.array(times), *facts], ["doc_id", "held", "hash", "key", "word", "times", "tokens", "hits", "part", "ppm"])
        release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "text", "held", "hash").mapInArrow(score, f"doc_id {kind}, held boolean, hash long, key long, word binary, times int, tokens long, hits long, part double, ppm double")
    others = keys.where(other_keys).select("key", F.lit(b"").alias("word"), "log_p")
    others = others.unionByName(known.where(~short | other_words).select("key", "word", F.log10(F.col("value") + F.lit(1.0)).alias("log_p")))
    out = out.join(others, ["key", "word"], "left")
    word, ppm = F.when(is_word, F.col("times")), F.when(F.col("key") >= 0, F.col("times"))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by_doc = out.groupBy("doc_id", "held", "hash").agg(
        add(word * F.col("log_p")).alias("tail"),
        add(F.when(F.col("log_p").isNotNull(), word)).alias("tail_hits"),
        add(ppm * F.col("log_p")).alias("rare"),
        F.count("tokens").alias("copies"),
        *(F.max(c).alias(c) for c in ("tokens", "hits", "part", "ppm")),
    )
    spread, end = float(np.log10(n + v + 1)), float(np.log10(ends + 1))
    # Rows repeated in full share a group; their rare words and keys are as often in it as they are repeated.
    return by_doc.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        F.col("held").alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("hits") + F.col("tail_hits") / F.col("copies") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("part") + F.col("tail") / F.col("copies") + F.lit(end) - F.col("tokens") * F.lit(spread)).alias("base_score"),
        (F.col("ppm") + F.col("rare") / F.col("copies")).alias("score"),
    )


_KEPT: list = []


def _tables(model: tuple) -> tuple[Lookup, Lookup]:
    """The tables of frequent keys and words, made once a worker process and model."""
    if not _KEPT or _KEPT[0] is not model:
        _KEPT[:] = [model, (Lookup(model[0]), Lookup(model[2]))]
    return _KEPT[1]
