"""Token counts of whole texts by a public byte-pair vocabulary, fast.

Byte-pair encoding works within pre-tokens, and a corpus has far fewer different pre-tokens than tokens. Texts are cut
into pre-tokens with array operations, equal ones are found by hash, and only one of each is encoded; the counts are
those of the tokenizer itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import LETTER, OTHER, SPACE, codepoints, hash_spans, run_starts, slices

# Endings that the pattern of the vocabulary cuts off after an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def default_vocabulary() -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pretoken_starts(cp: np.ndarray, cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of all texts begin: an ending after an apostrophe; runs of letters, numbers or other signs,
    each with one blank in front; what is left of white space."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    new = run_starts(cls, offsets)
    space = cls == SPACE
    nxt = np.append(new[1:], True)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    # The last white space before something else: a blank joins what follows, others stand alone.
    last = space & nxt & ~border[1:]
    new[last] = True
    joined = np.flatnonzero(last & (cp == 32))
    new[joined + 1] = False
    # An apostrophe on its own, without a blank in front, followed by an ending.
    quote = np.flatnonzero((cp == 39) & new & nxt & (cls == OTHER))
    quote = quote[(quote + 1 < n)]
    quote = quote[~border[quote + 1] & (cls[np.minimum(quote + 1, n - 1)] == LETTER)]
    if len(quote):
        a = cp[quote + 1]
        second = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~border[np.minimum(quote + 2, n)], cp[second], 0)
        two = np.zeros(len(quote), bool)
        for x, y in TWO_LETTERS:
            two |= (a == ord(x)) & (b == ord(y))
        one = np.isin(a, [ord(c) for c in ONE_LETTER])
        for pick, size in ((one, 1), (two & ~one, 2)):
            q = quote[pick]
            new[q + 1] = False
            rest = q + 1 + size
            rest = rest[rest < n]
            new[rest] = True
    return np.flatnonzero(new)


class TokenCounter:
    def __init__(self, path: str, most_known: int = 2_000_000) -> None:
        self.encoding, self.known, self.most = load_encoding(path), {}, most_known

    def counts(self, texts: list[str | None]) -> np.ndarray:
        cp, cls, offsets = codepoints(texts)
        out = np.zeros(len(texts), np.int64)
        if not len(cp):
            return out
        start = pretoken_starts(cp, cls, offsets)
        key, first, inverse = np.unique(hash_spans(cp, start), return_index=True, return_inverse=True)
        ends = np.append(start[1:], len(cp))
        size = np.empty(len(key), np.int64)
        if len(self.known) > self.most:
            self.known.clear()
        for i, (k, f) in enumerate(zip(key.tolist(), first.tolist())):
            c = self.known.get(k)
            if c is None:
                word = cp[start[f] : ends[f]].tobytes().decode("utf-32-le", "surrogatepass")
                c = self.known[k] = len(self.encoding.encode_ordinary(word)) if len(word) > 1 or ord(word) > 127 else 1
            size[i] = c
        total = np.concatenate([[0], np.cumsum(size[inverse])])
        at = np.searchsorted(start, offsets)
        return total[at[1:]] - total[at[:-1]]


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """The columns `keep` and `tokens`, one row per row. Null and empty texts have 0 tokens; texts are taken whole."""
    path = vocabulary or default_vocabulary()
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            arr = batch.column(batch.num_columns - 1)
            n = [counter.counts(arr.slice(lo, hi - lo).to_pylist()) for lo, hi in slices(arr)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=[*keep, "tokens"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, f"{types}, tokens long")
