"""Several values packed in one field, to one value per row with its position (problem 4).

Method: the Arrow buffer of the column is scanned with byte masks; quote parity by cumulative sums tells what lies
inside quotes, a delimiter mask gives the edges of the values, child offsets follow from the edges, a list array is
built on them and flattened with the parents' ordinals. No row is touched by a Python loop, but for fields with separators
beyond ASCII, which are blanked by a regular expression each. Fields that mix both kinds of quotes advance in lockstep, one
quoted stretch per step, all rows at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SINGLE, DOUBLE = 39, 34
#: A character beyond ASCII that is neither letter nor digit.
WIDE = re.compile(r"[^\x00-\x7f\w]")


def _word_bytes(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, z in ((48, 57), (65, 90), (97, 122)):
        table[a : z + 1] = True
    table[95] = True
    table[128:] = True  # bytes of letters beyond ASCII; separators beyond ASCII are blanked before
    return table[data]


def _ascii_separators(arr: pa.Array) -> pa.Array:
    """Blank what is neither ASCII nor a letter or digit, so that every byte from 128 on belongs to a word.

    Quoted stretches are cut from the original text, so they are not changed by this.
    """
    if not pc.any(pc.invert(pc.string_is_ascii(arr))).as_py():
        return arr
    return pc.replace_substring_regex(arr, r"[^\x00-\x7F\p{L}\p{N}]", " ")


def split_packed(arr: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """Per field the list of its values: (rows that are not null, ListArray over them)."""
    arr = arr.cast(pa.large_string())
    rows = np.flatnonzero(arr.is_valid().to_numpy(zero_copy_only=False))
    arr = arr.drop_null()
    blank = _ascii_separators(arr)
    if not pc.all(pc.equal(pc.binary_length(blank), pc.binary_length(arr))).as_py():
        # Wide separators change the length of their field: there, each becomes as many blanks as it has bytes.
        off = pc.not_equal(pc.binary_length(blank), pc.binary_length(arr))
        kept = [WIDE.sub(lambda m: " " * len(m.group().encode()), x) for x in arr.filter(off).to_pylist()]
        blank = pc.replace_with_mask(blank, off, pa.array(kept, pa.large_string()))
    n = len(arr)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    flat = np.frombuffer(blank.buffers()[2] or b"", np.uint8)[: len(data)] if n else data
    offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    open_at, close_at = _quoted(data, offsets, row_of)
    inside = np.zeros(len(data) + 1, np.int32)  # 1 from an opening quote up to and with its closing one
    np.add.at(inside, open_at, 1)
    np.add.at(inside, close_at + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    word = _word_bytes(flat) & ~inside
    prev = np.empty_like(word)
    if len(word):
        prev[0], prev[1:] = False, word[:-1]
        prev[offsets[:-1][np.diff(offsets) > 0]] = False  # a run ends with its field
        nxt = np.append(word[1:], False)
        nxt[offsets[1:][np.diff(offsets) > 0] - 1] = False
        begin, end = np.flatnonzero(word & ~prev), np.flatnonzero(word & ~nxt) + 1
    else:
        begin = end = np.zeros(0, np.int64)
    b, e = np.concatenate([begin, open_at + 1]), np.concatenate([end, close_at])
    quote = np.concatenate([np.zeros(len(begin), np.uint8), data[open_at] if len(open_at) else np.zeros(0, np.uint8)])
    order = np.argsort(b, kind="stable")
    b, e, quote = b[order], e[order], quote[order]
    parent = np.searchsorted(offsets, np.concatenate([begin, open_at])[order], side="right") - 1
    # One copy of the values' bytes, one after the other.
    length = e - b
    ends = np.cumsum(length)
    take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(b, length)
    child = pa.LargeStringArray.from_buffers(len(b), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes()))
    for q, one in ((SINGLE, "'"), (DOUBLE, '"')):
        if (quote == q).any():
            child = pc.if_else(pa.array(quote == q), pc.replace_substring(child, one * 2, one), child)
    counts = np.bincount(parent, minlength=n) if n else np.zeros(0, np.int64)
    return rows, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), child.cast(pa.string()))


def _quoted(data: np.ndarray, offsets: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the opening and closing quotes of all quoted stretches, in order.

    A doubled quote of the same kind inside stands for one. An opening quote that is never closed only separates.
    """
    n = len(offsets) - 1
    is_q = {q: data == q for q in (SINGLE, DOUBLE)}
    has = {q: np.bincount(row_of[is_q[q]], minlength=n) if len(data) else np.zeros(n, np.int64) for q in is_q}
    opened, closed = [], []
    for q, other in ((SINGLE, DOUBLE), (DOUBLE, SINGLE)):
        # Even count of one kind alone: parity decides. Two neighbouring toggles without a byte between are a doubled quote.
        simple = (has[q] > 0) & (has[other] == 0) & (has[q] % 2 == 0)
        at = np.flatnonzero(is_q[q] & simple[row_of])
        if not len(at):
            continue
        o, c = at[0::2], at[1::2]
        glued = np.zeros(len(o), bool)
        glued[1:] = (o[1:] == c[:-1] + 1) & (row_of[o[1:]] == row_of[c[:-1]])
        opened.append(o[~glued])
        closed.append(c[np.append(~glued[1:], True)])
    hard = np.flatnonzero(((has[SINGLE] > 0) & (has[DOUBLE] > 0)) | ((has[SINGLE] + has[DOUBLE]) % 2 == 1))
    # Lockstep: every hard row looks for its next quoted stretch from where it stands.
    marks = {q: np.flatnonzero(is_q[q]) for q in is_q}
    at, stop = offsets[hard].copy(), offsets[hard + 1]
    big = len(data) + 1
    while len(at):
        nexts = {}
        for q in is_q:
            i = np.searchsorted(marks[q], at)
            nexts[q] = np.where(i < len(marks[q]), marks[q][np.minimum(i, len(marks[q]) - 1)] if len(marks[q]) else big, big)
        start = np.minimum(nexts[SINGLE], nexts[DOUBLE])
        live = start < stop
        start, stop = start[live], stop[live]
        if not len(start):
            break
        kind = data[start]
        end = np.full(len(start), -1, np.int64)
        back = end.copy()  # if nothing closes it, the first of its last doubled quotes does
        seek, todo = start + 1, np.arange(len(start))
        while len(todo):  # the next quote of the kind; a doubled one is stepped over
            place = np.full(len(todo), big, np.int64)
            for q in is_q:
                of = kind[todo] == q
                i = np.searchsorted(marks[q], seek[of])
                place[of] = np.where(i < len(marks[q]), marks[q][np.minimum(i, max(len(marks[q]) - 1, 0))] if len(marks[q]) else big, big)
            ok = place < stop[todo]
            end[todo[~ok]] = back[todo[~ok]]
            todo, place = todo[ok], place[ok]
            follow = place + 1 < stop[todo]
            double = np.zeros(len(todo), bool)
            double[follow] = data[place[follow] + 1] == kind[todo[follow]]
            end[todo[~double]] = place[~double]
            back[todo[double]] = place[double]
            todo, seek = todo[double], place[double] + 2
        done = end >= 0
        opened.append(start[done])
        closed.append(end[done])
        at = np.where(done, end + 1, start + 1)
    if not opened:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    o, c = np.concatenate(opened), np.concatenate(closed)
    order = np.argsort(o)
    return o[order], c[order]


def explode_packed(df: DataFrame, field: str, keep: list[str], *, position: str = "position", value: str = "value") -> DataFrame:
    """One row per value of `field`: the columns `keep`, the position from 1, the value.

    Outside quotes a value is a longest run of letters, digits and underscores and all else separates. A stretch in
    single or double quotes is one value, verbatim, a doubled quote of its kind standing for one; an empty quoted
    stretch is an empty value. A quote that is never closed only separates. Null and empty fields, and fields without
    values, give no row. Repeated values and rows are all kept. Fields of any length are taken whole.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{field}`").cast("string").alias("__packed"))
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = split_packed(batch.column(batch.num_columns - 1))
            parents = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            starts = lists.offsets.to_numpy().astype(np.int64)
            place = np.arange(len(parents)) - starts[parents] + 1
            up = pa.array(rows[parents])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(up) for i in range(len(keep))), pa.array(place), lists.flatten()], names=[*keep, position, value])

    return source.mapInArrow(run, f"{types}, `{position}` long, `{value}` string")
