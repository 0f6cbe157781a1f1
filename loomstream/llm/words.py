"""Words of many texts at once: where they are and their 64-bit hashes."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that words are cut from at once.
STEP = 1 << 17
WHITE = np.zeros(256, np.int8)
WHITE[[9, 10, 11, 12, 13, 32]] = 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def texts_apart(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """raw with a white-space byte before each text, so that no word goes over from one into the next."""
    out = np.full(len(raw) + len(offsets) - 1, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = raw
    return out


def _hashes_of_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    white = WHITE[raw]
    # begin: 1 at the first byte of a word; end: -1 behind its last one.
    edge = np.diff(white, prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    # A word's hash: the sum of its bytes' hashes by place in the word.
    begin = np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(raw)]])))
    each = mixed(((np.arange(len(raw)) - begin) * 256 + raw + (1 << 40)).view(np.uint64))
    each[white.view(bool)] = 0
    return start, end, mixed(np.add.reduceat(each, start) + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of lower-cased bytes; a word is a maximal run without ASCII white space.  Bytes are
    taken in steps that end in white space, so that a long text needs little more memory than its words' hashes."""
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    while at < len(raw):
        end = at + STEP
        while end < len(raw) and not (white := np.flatnonzero(WHITE[raw[end : end + STEP]])).size:
            end += STEP
        end = min(len(raw), end + int(white[0])) if end < len(raw) else len(raw)
        start, stop, own = _hashes_of_words(raw[at:end])
        found.append((start + at, stop + at, own))
        at = end
    start, stop, own = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, stop, own
