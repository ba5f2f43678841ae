"""Words of many texts as arrays of 64-bit hashes, without a Python loop over words or rows."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_POW = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_TABLE = np.zeros(256, bool)
for _a, _z in ((48, 57), (97, 122), (128, 255)):
    _TABLE[_a : _z + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the output (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA5CB9243F1A1F1B5)
    return x ^ (x >> np.uint64(32))


def plain(arr: pa.Array) -> pa.Array:
    """Lower case; whatever is beyond ASCII and no letter or digit becomes a blank."""
    return pc.replace_substring_regex(pc.utf8_lower(arr.cast(pa.large_string())), r"[^\x00-\x7F\p{L}\p{N}]+", " ")


def _pieces(text: str) -> list[str]:
    """A very long text in parts of at most SLICE_BYTES characters, cut at white space where there is any."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        out.append(text[at:end])
        at = end
    return out


def slices(arr: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most SLICE_BYTES of text, or one row."""
    size = np.nan_to_num(pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.float64)).cumsum() if len(arr) else np.zeros(0)
    at = 0
    while at < len(arr):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield at, end
        at = end


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of the rows in them). Null texts have no words.

    A word is a longest run of letters and digits, in lower case. Texts of any length are taken whole.
    """
    if len(arr) == 1 and arr[0].is_valid and pc.binary_length(arr[0]).as_py() > 2 * SLICE_BYTES:
        parts = [words(pa.array([p], pa.large_string()))[0] for p in _pieces(arr[0].as_py())]
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    clean = plain(pc.fill_null(arr, ""))
    n = len(clean)
    offsets = np.frombuffer(clean.buffers()[1], np.int64)[clean.offset : clean.offset + n + 1]
    data = np.frombuffer(clean.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # A separator byte in front of every row keeps words from running over the border.
    mask = _TABLE[data]
    edge = np.empty(len(mask), bool)
    if len(mask):
        edge[0], edge[1:] = mask[0], mask[1:] & ~mask[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(mask)]
        edge[firsts] = mask[firsts]
    start = np.flatnonzero(edge)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(mask)
    first = np.flatnonzero(edge[at])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return _hash_runs(data[at], place, first), np.searchsorted(start, offsets)


def _hash_runs(values: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per run of values; place: position of a value in its run."""
    power = _POW[place & 63] ^ ((place >> 6).astype(np.uint64) * np.uint64(0xD1342543DE82EF96))
    return mix(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * power, first))


#: Classes of characters.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return table


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, their classes, offsets of the texts). A null text counts as an empty one."""
    texts = [t or "" for t in texts]
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return cp, _classes()[cp], offsets


def run_starts(cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Is a character the first of a longest run of one class within its text?"""
    new = np.empty(len(cls), bool)
    if len(cls):
        new[0], new[1:] = True, cls[1:] != cls[:-1]
        new[offsets[:-1][offsets[:-1] < len(cls)]] = True
    return new


def hash_spans(cp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One hash per span; spans begin at `start` (the first at 0) and fill the whole array."""
    place = np.arange(len(cp)) - np.repeat(start, np.diff(np.append(start, len(cp))))
    return _hash_runs(cp, place, start)


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each place on, offsets of the rows in them); rows with fewer words have none."""
    n = len(h) - k + 1
    count = np.maximum(np.diff(offsets) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    if n <= 0 or not out[-1]:
        return np.zeros(0, np.uint64), out
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    keep = np.repeat(offsets[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    return mix(s)[keep], out
