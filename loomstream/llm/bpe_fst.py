"""Byte-level BPE compiled to finite-state transducers.

Two deterministic machines read a text:

* The splitter reads one symbol a character (letter, number, other, apostrophe of a contraction, white space by
  what follows it) and marks where a word begins.  Texts are cut into chunks; each chunk's map from entry state to
  exit state is computed on its own, the maps are composed by a parallel prefix scan, and only the few characters
  before a chunk's map becomes constant are read again with the entry state then known.
* The word transducer reads bytes.  Its state after a prefix holds the longest suffix that may still grow into a
  token and, for each place where such a token could begin, the last token of the encoding up to there and the
  count of tokens relative to now.  The encoding of a prefix ends in the one token that the encoding before it may
  precede (both together encode to just these two), so a transition is deterministic and carries the change of the
  token count as its output; a state carries the prefix's last token, from which the ids are read backwards.
  Transitions are compiled when first met and kept until the worker process turns to another operator; the number
  of states is bounded by the vocabulary and not by the corpus.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata

import numpy as np

from .common import ROOM, distinct

# Code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]

# States of the splitter.
AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
# Its symbols; white space is INNER when more white space or the end follows, LAST otherwise.
LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACE_INNER, SPACE_LAST, WHITE_INNER, WHITE_LAST = range(9)
N_STATES, N_SYMBOLS, CHUNK = 8, 9, 512

PLACE = struct.Struct("<Bib")
#: A worker that has compiled more states than this starts its table anew, which bounds its memory.
MOST_STATES = 600_000
#: Pairs of tokens of which a worker knows whether one can follow the other; beyond it, it starts anew as well.
MOST_PAIRS = 2_000_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE_LAST (the space) or WHITE_LAST (other white space) of each code point."""
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    out = np.full(0x110000, OTHER, np.uint8)
    out[major == ord("L")], out[major == ord("N")] = LETTER, NUMBER
    out[WHITE_SPACE] = WHITE_LAST
    out[32] = SPACE_LAST
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word begins before the character), flat by state * 18 + symbol; symbol + 9 opens a text."""
    step = np.zeros((N_STATES, 2 * N_SYMBOLS), np.uint8)
    begins = np.ones((N_STATES, 2 * N_SYMBOLS), bool)
    for state in range(N_STATES):
        for first in (0, N_SYMBOLS):
            s = AT_START if first else state
            for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
                step[state, first + symbol] = run
                begins[state, first + symbol] = s not in (run, AFTER_SPACE)
            if s in (ONE_MORE, TWO_MORE):
                step[state, first + LETTER] = AT_START if s == ONE_MORE else ONE_MORE
                begins[state, first + LETTER] = False
            for symbol, rest in ((QUOTE_1, ONE_MORE), (QUOTE_2, TWO_MORE)):
                in_run = s in (IN_OTHER, AFTER_SPACE)
                step[state, first + symbol] = IN_OTHER if in_run else rest
                begins[state, first + symbol] = not in_run
            for symbol in (SPACE_INNER, WHITE_INNER):
                step[state, first + symbol] = IN_WHITE
                begins[state, first + symbol] = s != IN_WHITE
            step[state, first + SPACE_LAST], step[state, first + WHITE_LAST] = AFTER_SPACE, AT_START
    return step.reshape(-1), begins.reshape(-1)


def symbols(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The splitter's symbols of code points; first: indices of characters that open a text."""
    cls = char_classes()[chars]
    n = len(chars)
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    last[-1:] = True
    white = cls >= SPACE_LAST
    more = np.empty(n, bool)
    more[:-1] = white[1:]
    more |= last
    cls[white & more] -= 1  # SPACE_LAST, WHITE_LAST to their INNER forms
    at = np.flatnonzero(chars == 39)
    if len(at):
        padded = np.concatenate([chars, np.zeros(2, chars.dtype)])
        a, b = padded[at + 1].astype(np.int64), padded[at + 2].astype(np.int64)
        ends = np.concatenate([last, np.ones(2, bool)])
        one = ~ends[at] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~ends[at] & ~ends[at + 1] & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        cls[at[one]], cls[at[two]] = QUOTE_1, QUOTE_2
    cls[first] += N_SYMBOLS
    return cls


def word_starts(sym: np.ndarray) -> np.ndarray:
    """Where words begin, by chunk state maps and their prefix scan."""
    step, begins = splitter()
    width = 2 * N_SYMBOLS
    n = len(sym)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, WHITE_INNER, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T).astype(np.intp)
    flags = np.empty((CHUNK, chunks), bool)
    # Every entry state is followed until each chunk's map is constant.
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (chunks, N_STATES))
    known = 0
    while known < CHUNK and not (maps == maps[:, :1]).all():
        maps = step[maps.astype(np.intp) * width + grid[known][:, None]]
        known += 1
    state = maps[:, 0]
    constant = (maps == maps[:, :1]).all()
    if constant:
        for k in range(known, CHUNK):
            at = state.astype(np.intp) * width + grid[k]
            flags[k] = begins[at]
            state = step[at]
        maps = np.repeat(state[:, None], N_STATES, 1)
    # Inclusive prefix scan of the maps by doubling: maps[i] becomes chunk i after chunks 0 to i - 1.
    d = 1
    while d < chunks:
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)])
        d *= 2
    state = np.concatenate([np.full(1, AT_START, np.uint8), maps[:-1, AT_START]])
    for k in range(known if constant else CHUNK):
        at = state.astype(np.intp) * width + grid[k]
        flags[k] = begins[at]
        state = step[at]
    return np.ascontiguousarray(flags.T).reshape(-1)[:n]


def _bytes_of_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    for b in range(256):
        if b not in keep:
            out[chr(256 + len(out) - len(keep))] = b
    return out


class Transducer:
    """Counts or lists the tokens of texts as the vocabulary's library does with add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _bytes_of_chars()
        vocab = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.special = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
        self.merged: dict[int, int] = {}
        self.parts = [(i, i) for i in range(max(vocab.values()) + 1)]
        made = {i for w, i in vocab.items() if len(w) == 1}
        for pair in spec["model"]["merges"]:
            left, right = (bytes(back[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole < max(a, b, len(made) - 1) or whole in made:
                raise ValueError("ids must follow the order of the merges")
            made.add(whole)
            self.merged[a << 24 | b], self.parts[whole] = whole, (a, b)
        self.vocab = {w: i for w, i in vocab.items() if i in made}
        self.words = {i: w for w, i in vocab.items()}
        self.prefixes = {w[:k] for w in self.vocab for k in range(1, len(w) + 1)}
        self.token_len = np.zeros(max(self.words) + 2, np.int32)
        for i, w in self.words.items():
            self.token_len[i] = len(w)
        self.valid: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Start the lazy compilation anew."""
        self.pairs: dict[int, bool] = {}
        self.states: list[bytes] = []
        self.ids: dict[bytes, int] = {}
        self.last = np.full(1024, -1, np.int32)
        # Open addressing: state * 256 + byte to target * 256 + change of the count + 128.
        self.keys = np.full(1 << 14, -1, np.int64)
        self.values = np.zeros(1 << 14, np.int64)
        self.filled = 0
        self.start = self._state(b"", ((0, -1, 0),))

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge joins across the border of tokens a and b when their bytes are encoded together.

        Merges apply in the order of ids, so the border is undone step by step from the latest merge: a pair across
        it that merges before the side that holds it was finished would have been taken.
        """
        limit = len(self.parts)
        while True:
            if self.merged.get(a << 24 | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True

    def _reached(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        a, b = self.parts[token]
        return a == b == token or (self._reached(a) and self._reached(b) and self._apart_before(a, b, token))

    def _apart_before(self, a: int, b: int, whole: int) -> bool:
        limit, self.merged[a << 24 | b] = self.merged[a << 24 | b], len(self.parts)
        try:
            return self._apart(a, b)
        finally:
            self.merged[a << 24 | b] = limit

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: the word's begin) in an encoding."""
        if b not in self.valid:
            self.valid[b] = self._reached(b)
        if a < 0 or not self.valid[b]:
            return self.valid[b]
        pair = a << 24 | b
        if pair not in self.pairs:
            self.pairs[pair] = self._apart(a, b)
        return self.pairs[pair]

    def _state(self, suffix: bytes, places: tuple) -> int:
        """places: (length of the suffix from there, last token before it, its count less the count now)."""
        key = bytes((len(suffix),)) + suffix + b"".join(PLACE.pack(*x) for x in places)
        if key in self.ids:
            return self.ids[key]
        i = self.ids[key] = len(self.states)
        self.states.append(key)
        if i >= len(self.last):
            self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
        self.last[i] = places[-1][1]
        return i

    def _compile(self, state: int, byte: int) -> None:
        key = self.states[state]
        n = key[0]
        suffix, c = key[1 : 1 + n], bytes((byte,))
        found = None
        grown = []
        for length, token, rel in PLACE.iter_unpack(key[1 + n :]):
            word = suffix[n - length :] + c
            if found is None and word in self.vocab and self._follows(token, self.vocab[word]):
                found = (self.vocab[word], rel + 1)
            if word in self.prefixes:
                grown.append((len(word), token, rel))
        if found is None:
            raise ValueError("the vocabulary is not a byte-level BPE vocabulary")
        token, delta = found
        places = (*((m, t, rel - delta) for m, t, rel in grown), (0, token, 0))
        target = self._state((suffix + c)[len(suffix) + 1 - places[0][0] :], places)
        self._put(state << 8 | byte, target << 8 | (delta + 128))

    def _put(self, key: int, value: int) -> None:
        if self.filled * 2 > len(self.keys):
            old = self.keys >= 0
            keys, values = self.keys[old], self.values[old]
            self.keys, self.values = np.full(len(self.keys) * 2, -1, np.int64), np.zeros(len(self.keys) * 2, np.int64)
            left = np.arange(len(keys))
            slot = self._slot(keys)
            while len(left):  # of rows that meet in a free slot the last written one has it, the others go on
                free = self.keys[slot[left]] < 0
                self.keys[slot[left[free]]] = keys[left[free]]
                left = left[self.keys[slot[left]] != keys[left]]
                slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            at = slot
            self.values[at] = values
        slot = int(self._slot(np.array([key]))[0])
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.values[slot] = key, value
        self.filled += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        shift = np.uint64(65 - len(self.keys).bit_length())
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The transitions' values; those not compiled yet are compiled."""
        slot = self._slot(keys)
        there = self.keys[slot]
        if (there == keys).all():
            return self.values[slot]
        left = np.flatnonzero(there != keys)
        missing = []
        while len(left):
            empty = self.keys[slot[left]] < 0
            missing.append(left[empty])
            left = left[~empty]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            left = left[self.keys[slot[left]] != keys[left]]
        new = distinct(keys[np.concatenate(missing)])
        if len(new):
            for x in new.tolist():
                self._compile(x >> 8, x & 255)
            return self._find(keys)
        return self.values[slot]

    def _run(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Token count of each word; with keep also the state after each byte."""
        if len(self.states) > MOST_STATES or len(self.pairs) > MOST_PAIRS:
            self._forget()
        order = np.argsort(-lengths.astype(np.int32), kind="stable")
        at, left = starts[order], lengths[order]
        counts = np.zeros(len(starts), np.int64)
        state = np.full(len(starts), self.start, np.int64)
        after = np.zeros(len(raw), np.int32) if keep else None
        most = int(left[0]) if len(left) else 0
        active = len(left) - np.searchsorted(left[::-1], np.arange(most), "right")
        for k in range(most):
            n = int(active[k])
            pos = at[:n] + k
            value = self._find(state[:n] << 8 | raw[pos])
            counts[:n] += (value & 255) - 128
            state[:n] = value >> 8
            if after is not None:
                after[pos] = state[:n]
        out = np.empty_like(counts)
        out[order] = counts
        return out, after

    def _words(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and lengths of the words of all texts, and the id of those that are special tokens (else -1)."""
        blob = raw.tobytes()
        cuts, special = [], {}
        for word, token in self.special:
            i = blob.find(word)
            while i >= 0:
                doc = int(np.searchsorted(offsets, i, "right")) - 1
                if i + len(word) <= offsets[doc + 1]:
                    special[i] = (len(word), token)
                    cuts += [i, i + len(word)]
                    i = blob.find(word, i + len(word))
                else:
                    i = blob.find(word, i + 1)
        head = (raw & 0xC0) != 0x80
        chars = np.frombuffer(blob.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(head) if len(chars) != len(raw) else np.arange(len(raw))
        if len(at) != len(chars):
            raise ValueError("texts must be valid UTF-8")
        begin = distinct(np.concatenate([offsets[:-1], np.array(cuts, np.int64)]))
        begin = begin[begin < len(raw)]
        first = np.searchsorted(at, begin)
        flags = word_starts(symbols(chars, first))
        starts = at[flags]
        ids = np.full(len(starts), -1, np.int32)
        if special:
            inside = np.zeros(len(raw) + 1, np.int32)
            for i, (n, _) in special.items():
                inside[i + 1] += 1
                inside[i + n] -= 1
            starts = starts[np.cumsum(inside)[starts] == 0]
            ids = np.array([special[i][1] if i in special else -1 for i in starts.tolist()], np.int32)
        return starts, np.diff(np.append(starts, len(raw))), ids

    def count(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Tokens of each text; offsets and raw as from common.buffers."""
        if not len(raw):
            return np.zeros(len(offsets) - 1, np.int64)
        starts, lengths, special = self._words(offsets, raw)
        counts, _ = self._run(raw, starts, np.where(special < 0, lengths, 0), False)
        total = np.concatenate([[0], np.cumsum(np.where(special < 0, counts, 1), dtype=np.int64)])
        return np.diff(total[np.searchsorted(starts, offsets)])

    def encode(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the tokens of each text."""
        if not len(raw):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        starts, lengths, special = self._words(offsets, raw)
        counts, after = self._run(raw, starts, np.where(special < 0, lengths, 0), True)
        counts = np.where(special < 0, counts, 1)
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        out = np.zeros(int(total[-1]), np.uint32)
        out[total[:-1][special >= 0]] = special[special >= 0]
        plain = np.flatnonzero(special < 0)
        end, low, slot = starts[plain] + lengths[plain], starts[plain], total[plain + 1] - 1
        while len(end):
            token = self.last[after[end - 1]]
            out[slot] = token
            end = end - self.token_len[token]
            on = end > low
            end, low, slot = end[on], low[on], slot[on] - 1
        return total[np.searchsorted(starts, offsets)], out


@functools.cache
def transducer(path: str) -> Transducer:
    """One compiled transducer a worker process and vocabulary."""
    return Transducer(path)


ROOM.append(transducer.cache_clear)
