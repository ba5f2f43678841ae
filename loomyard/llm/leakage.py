"""Evaluation texts leaking into training text (problem 8).

Method: exact shingle containment. Every shingle of a document is looked up among those of the items, and the item words
that a document's shingles cover are counted by stretches (no more than MAX_DAMAGE uncovered words in a row). What a chain
can match is bounded by what its stretch covers: (document, item) pairs whose stretches cover less than LEAST_COVER of
min_words are left out; all others are verified: matching runs are chained in the order of both texts, and a chain counts if it spans
at least min_words words of the item, at least RARE_SHARE of its shingles are no stock phrase, and either its matching
shingles hold min_words words (and LOOSE_COVER of the span; min_cover, if something long stands between), or, with the words
between and beyond the shingles compared one by one, SURE_COVER of the words agree. So damage near an end of a passage loses
nothing but a damaged first or last word. A gap in the item (a damaged word or two) is bounded, one in the document (matter standing inside the passage) is wider.

Stock phrases are shingles of more than MAX_STOCK different items. Items of the same words are one item here, and a run of
min_words words that several items share is a passage they share, no stock: its shingles count as rare. So a leak is found
however many items hold it; words that more than MAX_STOCK items share only in runs under min_words count as stock.

Scale: the items are a stated query set, taken in blocks of at most block_words words (checked on their count); one block's
shingles are broadcast and every document is read once per block. Stock is counted over the items of all blocks. No shuffle
and no pairs of documents; the shingles of documents are matched in parts of PART postings, or of one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import shingles, slices, words

K = 5
#: A shingle of more different items than this is a stock phrase, unless it stands in a passage that they share.
MAX_STOCK = 2
#: Least share of shingles that are no stock in a chain.
RARE_SHARE = 0.4
#: Postings matched at a time.
PART = 4_000_000
#: Words of the item that may be lost in a row, to damage or at an insertion. An insertion of more than MAX_INSERTED words, of
#: whatever length, needs MIN_SIDE matched words on either side of it.
MAX_DAMAGE = 12
MAX_INSERTED = 120
MIN_SIDE = 15
#: A pair is proposed if a stretch covers this share of min_words: 25 of 40 words, the least that three damaged words leave
#: covered in a passage of 40; longer passages bear more.
LEAST_COVER = 0.62
#: Share of the span in matching shingles that is enough where these alone are min_words and nothing long stands between.
LOOSE_COVER = 0.45
#: Where the words of both texts agree, place by place, on at least this share of the span, the matched words on either side
#: of a long insertion may be as few as SURE_SIDE, and the words beyond the shingles count.
SURE_COVER = 0.85
SURE_SIDE = 8
#: A chain that loses more words than this at an insertion, or has a long one, must reach min_cover,
#: and have this share of its shingles outside stock.
MAX_LOST = 4
RARE_WIDE = 0.67


class ItemIndex:
    """Shingles of a block of items with their postings (item, place); items of the same words are one, with several members.

    stock and repeated: shingles of too many items, and runs of min_words words of several items, where the block isn't all.
    """

    def __init__(self, ids: list, texts: list[str | None], min_words: int = 40, stock: np.ndarray | None = None, repeated: np.ndarray | None = None) -> None:
        h, off = words(pa.array(texts, pa.large_string()))
        same: dict[bytes, list[int]] = {}
        for i in range(len(ids)):
            same.setdefault(h[off[i] : off[i + 1]].tobytes(), []).append(i)
        self.ids, self.members = ids, list(same.values())
        h, off = words(pa.array([texts[m[0]] for m in self.members], pa.large_string()))
        self.words, self.offsets = h, off
        s, so = shingles(h, off, K)
        w, wo = shingles(h, off, max(min_words, K))
        item = np.repeat(np.arange(len(self.members)), np.diff(so))
        order = np.argsort(s, kind="stable")
        self.length, self.start, self.owner = np.diff(off), so[:-1], item
        self.hash, self.item = s[order], item[order]
        self.place = (np.arange(len(s)) - np.repeat(so[:-1], np.diff(so)))[order]
        self.known, self.first = np.unique(self.hash, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.hash)))
        stock = _held(s, item, MAX_STOCK + 1) if stock is None else stock
        in_window = np.repeat(np.arange(len(self.members)), np.diff(wo))
        shared = np.flatnonzero(np.isin(w, _held(w, in_window, 2) if repeated is None else repeated))
        # Shingles of a shared run: from its first word to the last shingle inside it.
        begin = so[:-1][in_window[shared]] + shared - wo[:-1][in_window[shared]]
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + max(min_words, K) - K + 1, -1)
        #: By place over all items: is the shingle no stock?
        self.rare = ~np.isin(s, stock) | (np.cumsum(cover)[:-1] > 0)
        bits = max(20, int(np.ceil(np.log2(max(len(self.known), 1) * 16))))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.known >> self.shift] = True

    def lookup(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in s that are known, index of their shingle)."""
        at = np.flatnonzero(self.filter[s >> self.shift])
        if not len(self.known):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        hit = self.known[i] == s[at]
        return at[hit], i[hit]

    def postings(self, at: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of all pairs."""
        n = self.count[i]
        ends = np.cumsum(n)
        p = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.first[i], n)
        return np.repeat(at, n), self.item[p], self.place[p]


def _held(s: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """Hashes that at least so many items hold."""
    order = np.lexsort((item, s))
    s, item = s[order], item[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (item[1:] != item[:-1])
    known, n = np.unique(s[once], return_counts=True)
    return known[n >= least]


def candidates(s: np.ndarray, so: np.ndarray, index: ItemIndex, min_words: int = 40, min_cover: float = LEAST_COVER) -> np.ndarray:
    """(row, item) pairs, as rows of an array, of which some stretch covers as many words, and as many of them rare, as a chain that counts must match."""
    at, i = index.lookup(s)
    row_of = np.searchsorted(so, at, side="right") - 1
    # Whole rows, PART postings at a time.
    upto = np.append(0, np.cumsum(index.count[i]))
    edge = np.searchsorted(row_of, np.arange(len(so)))
    out, lo, n_items, total = [np.zeros((0, 2), np.int64)], 0, len(index.members), np.int64(len(index.rare))
    while lo < len(so) - 1:
        hi = max(lo + 1, int(np.searchsorted(upto[edge], upto[edge[lo]] + PART, side="right")) - 1)
        p, item, q = index.postings(at[edge[lo] : edge[hi]], i[edge[lo] : edge[hi]])
        key = np.sort((np.searchsorted(so, p, side="right") - 1) * total + index.start[item] + q)
        lo = hi
        if not len(key):
            continue
        key = key[np.append(True, key[1:] != key[:-1])]
        row, place = key // total, key % total
        pair = row * n_items + index.owner[place]
        step = np.append(K + MAX_DAMAGE + 1, np.diff(place))
        new = (step > K + MAX_DAMAGE) | np.append(True, pair[1:] != pair[:-1])
        begin = np.flatnonzero(new)
        covered = np.add.reduceat(np.where(new, K, np.minimum(step, K)), begin)
        rare = np.add.reduceat(index.rare[place].astype(np.int64), begin)
        need = np.minimum(min_words, index.length[index.owner[place[begin]]])
        ok = (covered >= min_cover * need) & (rare >= RARE_SHARE * min_cover * need / K)
        found = np.unique(pair[begin[ok]])
        out.append(np.stack([found // n_items, found % n_items], 1))
    return np.concatenate(out)


def _beyond(doc: np.ndarray, item: np.ndarray, a: int, b: int, step: int) -> tuple[int, int]:
    """(words to the last that agrees, words that agree) on from two places, word by word, until two in a row differ: the
    rest of a passage that a damaged word near its end has left without a shingle."""
    far = same = miss = n = 0
    while miss < 2 and 0 <= a < len(doc) and 0 <= b < len(item):
        n += 1
        if doc[a] == item[b]:
            far, same, miss = n, same + 1, 0
        else:
            miss += 1
        a, b = a + step, b + step
    return far, same


def best_chain(p: np.ndarray, q: np.ndarray, min_words: int, min_cover: float, rare: np.ndarray | None = None, doc: np.ndarray | None = None, item: np.ndarray | None = None) -> tuple[int, int] | None:
    """The best chain without long insertions or, if none counts, with them; see _chain."""
    hit = _chain(p, q, min_words, min_cover, rare, doc, item, False)
    if hit or not len(p) or int(p.max() - p.min()) <= MAX_INSERTED:
        return hit
    return _chain(p, q, min_words, min_cover, rare, doc, item, True)


def _chain(p: np.ndarray, q: np.ndarray, min_words: int, min_cover: float, rare: np.ndarray | None, doc: np.ndarray | None, item: np.ndarray | None, wide: bool) -> tuple[int, int] | None:
    """(words spanned in the item, words matched) of the best chain that counts, or None.

    A run may be followed by one after damage (both texts go on by about as many words) or after an insertion (the item
    goes on after at most as many words as damage may take, the document later). Matched are the words of matching
    shingles and, with the words of both texts given, those that agree place by place between and beyond them.

    p and q are the places of matching shingles in the document and the item; rare: which of them are no stock (all, if not given).
    """
    if doc is None or item is None:
        doc = item = np.zeros(0, np.uint64)
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    rare = np.ones(len(p), bool) if rare is None else rare[order]
    new = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(q) != 1)))
    size = np.diff(np.append(new, len(p)))
    best, done, far, oldest, reach = None, [], {}, 0, 0
    known = np.add.reduceat(rare.astype(np.int64), new) if len(p) else size
    for a, b, n, r in sorted(zip(p[new].tolist(), q[new].tolist(), size.tolist(), known.tolist())):
        # The chain that ends in this run: its first word in the item, the words matched, its shingles and those that are no stock.
        own = n + K - 1
        begin, more = a, 0
        end_a, end_b, first, got, every, sure, side, least, dense = a + own, b + own, b, own, n, r, own, None, False
        while oldest < len(done) and done[oldest][4] < a - MAX_INSERTED:
            # By its last word in the item, the best chain that ended so far back.
            old = done[oldest]
            if wide and old[7] >= SURE_SIDE and (old[1] not in far or far[old[1]][3] < old[3]):
                far[old[1]] = old
            oldest += 1
        for ea, eb, f, m, _, e, k, d, w, t, x, y in done[oldest:]:
            gap_a, gap_b = a - ea, b - eb
            damaged = -K < gap_b <= MAX_DAMAGE and abs(gap_a - gap_b) <= 2
            inserted = -K < gap_b <= MAX_DAMAGE and gap_b < gap_a <= MAX_INSERTED
            if end_b > eb and (damaged or inserted):
                between = int((doc[ea:a] == item[eb:b]).sum()) if 0 < gap_a == gap_b and len(doc) else 0
                c = m + min(own, end_b - eb)
                if c > got:
                    first, got, every, sure, side, least, begin, more = f, c, e + n, k + r, d + c - m, w, x, y + between
                    dense = t or not damaged and gap_b > MAX_LOST
        for eb in range(b - MAX_DAMAGE, b + K) if far else ():
            if eb in far and end_b > eb and (c := far[eb][3] + min(own, end_b - eb)) > got:
                old = far[eb]
                first, got, every, sure, side, begin, more = old[2], c, old[5] + n, old[6] + r, c - old[3], old[10], old[11]
                least = old[7] if old[8] is None else min(old[7], old[8])  # matched before the long insertion
                dense = True
        reach = max(reach, end_a)
        done.append((end_a, end_b, first, got, reach, every, sure, side, least, dense, begin, more))
        if sure < (RARE_WIDE if dense else RARE_SHARE) * every:
            continue
        sides, span = MIN_SIDE if least is None else min(side, least), end_b - first
        if sides >= MIN_SIDE and span >= min_words and got >= max(min_words, (min_cover if dense else LOOSE_COVER) * span) and (best is None or got > best[1]):
            best = (span, got)
        if sides < SURE_SIDE or span + 4 * K < min_words:  # too little for what may stand beyond
            continue
        left, before = _beyond(doc, item, begin - 1, first - 1, -1)
        right, after = _beyond(doc, item, end_a, end_b, 1)
        span, got = span + left + right, got + more + before + after
        if span >= min_words and got >= SURE_COVER * span and (best is None or got > best[1]):
            best = (span, got)
    return best


def search(arr: pa.Array, index: ItemIndex, min_words: int = 40, min_cover: float = 0.65) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, words spanned, words matched) of the texts that carry a passage."""
    for lo, hi in slices(arr):
        h, off = words(arr.slice(lo, hi - lo))
        s, so = shingles(h, off, K)
        found = candidates(s, so, index, min_words)
        if not len(found):
            continue
        for row in np.unique(found[:, 0]):
            own = s[so[row] : so[row + 1]]
            p, item, q = index.postings(*index.lookup(own))
            order = np.argsort(item, kind="stable")
            p, item, q = p[order], item[order], q[order]
            for i in found[found[:, 0] == row, 1]:
                of = slice(*np.searchsorted(item, [i, i + 1]))
                need = min(min_words, int(index.length[i]))
                if hit := best_chain(p[of], q[of], need, min_cover, index.rare[index.start[i] + q[of]], h[off[row] : off[row + 1]], index.words[index.offsets[i] : index.offsets[i + 1]]):
                    for m in index.members[i]:
                        yield lo + int(row), m, *hit


def _hashes(texts: DataFrame, k: int) -> DataFrame:
    """(h) of the different runs of k words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                s, so = shingles(*words(batch.column(0).slice(lo, hi - lo)), k)
                for i in range(hi - lo):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(s[so[i] : so[i + 1]]).view(np.int64))], names=["h"])

    return texts.mapInArrow(run, "h long")


def _shared(block: DataFrame, every: DataFrame, k: int, least: int) -> np.ndarray:
    """Hashes of runs of k words of the block that at least so many of all different items hold; at most the block's words."""
    many = _hashes(every, k).groupBy("h").count().where(F.col("count") >= least)
    return np.array([r.h for r in _hashes(block, k).distinct().join(many, "h", "left_semi").collect()], np.int64).view(np.uint64)


def leaked_passages(docs: DataFrame, items: DataFrame, *, doc_id: str, item_id: str, text: str = "text", min_words: int = 40, min_cover: float = 0.65, block_words: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, words_spanned, words_matched) for every document and item of which it carries a passage.

    A passage is at least min_words consecutive words of the item in order (the whole item if it is shorter); items of
    fewer than 5 words have no shingle and are never found. Null and empty texts hold nothing. Repeated documents are
    each reported. Texts are taken whole, whatever their length; columns other than id and text are ignored.
    """
    spark = docs.sparkSession
    need = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    size = F.size(F.split("text", r"\s+"))
    total = need.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    kind_d, kind_i = (df.schema[c].dataType.simpleString() for df, c in ((docs, doc_id), (items, item_id)))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = None
    for b in range(blocks):
        own, given = need, {}
        if blocks > 1:
            # Items of the same words fall into one block, and stock is counted over all blocks.
            same = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
            own = need.where(F.pmod(F.xxhash64(same), F.lit(blocks)) == b)
            every = need.select(same.alias("text")).distinct()
            given = {"stock": _shared(own.select("text"), every, K, MAX_STOCK + 1), "repeated": _shared(own.select("text"), every, max(min_words, K), 2)}
        rows = own.orderBy("id").collect()
        shared = spark.sparkContext.broadcast(ItemIndex([r.id for r in rows], [r.text for r in rows], min_words, **given))
        part = source.mapInArrow(_mapper(shared, min_words, min_cover), f"`{doc_id}` {kind_d}, `{item_id}` {kind_i}, words_spanned int, words_matched int")
        out = part if out is None else out.unionByName(part)
    return out


def _mapper(shared, min_words: int, min_cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = list(search(batch.column(1), index, min_words, min_cover))
            if found:
                row, item, span, got = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item]), pa.array(span, pa.int32()), pa.array(got, pa.int32())], names=["d", "i", "words_spanned", "words_matched"])

    return run
