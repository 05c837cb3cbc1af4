"""Small helpers that several operators share: words of a text, hashes of words, batches by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


AT_ONCE = 1 << 18   # bytes of text whose words are hashed together: the arrays over them are some fifty times as large
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MUL
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _xxh64(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``xxhash.xxh64_intdigest`` of each slice of ``data``, those of one size at a time; slices of 32 bytes or more by the library."""
    out = np.empty(start.size, np.uint64)
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))      # the eight bytes from each place on
    short = np.minimum(size, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    cut = np.searchsorted(short[order], np.arange(1, 34))
    for n in range(1, 32):
        at = order[cut[n - 1]:cut[n]]
        if not at.size:
            continue
        p, done = start[at], 0
        with np.errstate(over="ignore"):
            h = np.full(at.size, _P5 + np.uint64(n))
            for done in range(8, n + 1, 8):
                h = _turned(h ^ _turned(eight[p + (done - 8)] * _P2, 31) * _P1, 27) * _P1 + _P4
            left, k = n - done, eight[p + done] if n > done else None
            if left >= 4:
                h = _turned(h ^ (k & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
                k, left = k >> np.uint64(32), left - 4
            for i in range(left):
                h = _turned(h ^ (k >> np.uint64(8 * i) & np.uint64(255)) * _P5, 11) * _P1
            h = (h ^ h >> np.uint64(33)) * _P2
            h = (h ^ h >> np.uint64(29)) * _P3
            out[at] = h ^ h >> np.uint64(32)
    for i in order[cut[31]:].tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + size[i]])
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, A-Z in lower case, of all texts in order; where the words of each text begin, and where the last ends."""
    held = [(t or "").encode("utf-8") for t in texts]
    data = b"\n".join(held).lower()                    # bytes: only A-Z and ASCII white space count
    space = np.concatenate(([True], _SPACES[np.frombuffer(data, np.uint8)], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, stop = edge[::2], edge[1::2]
    begin = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in held)]))
    return _xxh64(data, start, stop - start), begin


def runs_of(h: np.ndarray, begin: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``runs`` of each text, of the word hashes of many texts as ``word_hashes`` has them."""
    n = np.diff(begin)
    out, keep = np.empty(h.size, np.uint64), np.zeros(h.size + 1, np.int64)
    if h.size >= words:
        out[:h.size - words + 1] = runs(h, words)
    for k in range(1, words):
        at = begin[:-1][n == k]
        if at.size:
            out[at] = _run([h[at + i] for i in range(k)], words)
    size = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    np.add.at(keep, begin[:-1], size > 0)
    np.add.at(keep, begin[:-1] + size, -(size > 0).astype(np.int64))
    return out[np.cumsum(keep)[:-1] > 0], np.concatenate(([0], np.cumsum(size)))


def shingle_lists(texts: list[str | None], words: int) -> list[np.ndarray]:
    """``shingle_hashes`` of each text, ``AT_ONCE`` characters at a time; a longer text stands alone."""
    out, few, held = [], [], 0
    for i, t in enumerate(texts):
        few.append(t)
        held += len(t or "")
        if held >= AT_ONCE or i == len(texts) - 1 or held + len(texts[i + 1] or "") > AT_ONCE:
            shingles, begin = runs_of(*word_hashes(few), words)
            out += np.split(shingles, begin[1:-1])
            few, held = [], 0
    return out


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hash of each run of ``words`` words in text order. A shorter text is one run; no word, none."""
    return runs(word_hashes([text])[0], words)


def runs(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of ``words`` word hashes, as ``shingle_hashes`` has them."""
    if h.size == 0:
        return h
    k = min(words, h.size)
    return _run([h[i:h.size - k + 1 + i] for i in range(k)], words)


def _run(words: list[np.ndarray], full: int) -> np.ndarray:
    """Hashes of runs, from those of their first words, of their second and so on; of a run that is a whole text fewer than ``full``."""
    out = np.zeros(words[0].size, np.uint64)
    with np.errstate(over="ignore"):
        for h in words:
            out = mix(out * np.uint64(3) + h + _MIX)
        if len(words) < full:
            out = mix(out + np.uint64(len(words)))
    return out


def by_bytes(column: pa.Array, limit: int) -> Iterator[list]:
    """Values of a text column in lists of at most ``limit`` bytes; a longer text stands alone."""
    if len(column) == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > limit:
            yield column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    yield column.slice(start).to_pylist()


def small(batches: Iterator[pa.RecordBatch], column: str = "snippet", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none has more than ``limit`` bytes of text; a longer text stands alone. Python objects are
    then made of a few megabytes at a time, whatever the size of the batches."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and held + n > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)
