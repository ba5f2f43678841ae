"""Template residue and error-page text (problem 10).

Method: positive-unlabelled naive Bayes, learned by expectation-maximization from trusted error and placeholder records.
Passages are scored and the record decided by its passages.

Two kinds of passages are taken from a text. Sentences: up to a full stop, a blank line or a new numbered paragraph.
Slots: the few tokens around a sign that prose doesn't use, a null literal or a "(word: word)" form, which find an
unfilled field inside an otherwise sound sentence. Features are tokens and token pairs; digits are one token, letters are
in lower case, a run of one sign is one token. The positive class is smoothed towards the background, so a feature never
seen in it counts against it, by a bounded amount. That keeps sentences in which a court reports such words as evidence
out: most of what surrounds the words speaks for the court.

Trusted records: above all, those records that are too short to be a decision, and slots of an unmistakable template syntax
or with a null literal outside quotation marks; the wordings are learned from these. A short list of standard texts
(TRUSTED_TEXTS: names of status codes, the classical filler, usual prompts) sets off what too few records show.
The model is fitted on bounded samples by hash of the id: sample_docs records of all and sample_short short ones. Every
record is scored, on its whole text.
An exact check follows: a null literal that stands in quotation marks is quoted, not left over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textvec import LETTER, NUMBER, OTHER, SPACE, codepoints, hash_spans, mix, run_starts, slices

BITS = 20
NUMBER_HASH, BEGIN, END = np.uint64(0x1234567), np.uint64(0x89ABCDE), np.uint64(0xFEDCBA9)
# Trusted records. Names of the HTTP status codes and their usual renderings, the requirement of scripts, the
# classical filler text, and the usual prompts of forms; in the languages of the corpus.
TRUSTED_TEXTS = (
    "400 Bad Request", "401 Unauthorized", "403 Forbidden", "404 Not Found", "408 Request Timeout", "410 Gone", "429 Too Many Requests",
    "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout",
    "Error 404", "Page not found", "Access denied", "Service unavailable", "Connection timed out", "Session expired",
    "Fehler 404", "Seite nicht gefunden", "Zugriff verweigert", "Dienst nicht verfügbar", "Zeitüberschreitung der Verbindung", "Sitzung abgelaufen",
    "Erreur 404", "Page introuvable", "Accès refusé", "Service indisponible", "Délai de connexion dépassé", "Session expirée",
    "Please enable JavaScript.", "JavaScript is required.", "Bitte aktivieren Sie JavaScript.", "JavaScript ist erforderlich.", "Veuillez activer JavaScript.", "JavaScript est requis.",
    "Please try again later.", "Bitte versuchen Sie es später erneut.", "Veuillez réessayer plus tard.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Placeholder text.", "Sample text.", "Dummy text.", "Enter text here.", "Type your text here.", "Insert text here.", "Text to follow.",
    "Platzhalter", "Mustertext", "Blindtext", "Text hier eingeben.", "Text folgt.", "Texte de remplissage", "Saisir le texte ici.", "Insérer le texte ici.", "Texte à venir.",
)
TRUSTED_SLOTS = (
    "{{ name }}", "{{name}}", "${name}", "${a.b}", "<%= name %>", "%(name)s", "%%NAME%%", "<<NAME>>", "[[name]]", "&&name&&", "@@name@@", "#{name}", "{0}",
    "<name/>", "#REF!", "[object Object]", "[enter name]", "[insert name]", "[name - ENTER]", "[to be completed name]", "[einsetzen Name]", "[Name - EINSETZEN]",
    "[à compléter]", "[insérer nom]", "(name: insert)", "(name: enter)", "(Name: bitte eintragen)", "[bitte eintragen Name]", "(nom: à compléter)", "[insert name]", "[●]", "____ (enter) ____", "XX.XX.20XX", "date: undefined", "name: NaN", "no. null",
)
#: A form of the list of slots counts as so many records.
SLOT_WEIGHT = 5
#: A slot of the sample is trusted if it begins with one of these signs; they have no use in prose.
TEMPLATE_SIGNS = ("{{", "${", "<%", "%(", "%%", "&&", "@@", "#{", "<<", "[[")
#: Signs that prose uses and that make no slot.
PROSE_SIGNS = ".,;:()'\"-–—/«»“”„‘’‚‹›§&…!?°*´`|·•+"
NULL_LITERALS = ("undefined", "nan", "null", "xx")
CLOSING = "]}>"
QUOTES = "'\"«»“”„‘’‚‹›"


def _word_hash(word: str) -> np.uint64:
    cp, _, _ = codepoints([word])
    return hash_spans(cp, np.zeros(1, np.int64))[0]


@dataclass
class Passages:
    """Token hashes, and the passages as ranges in them. doc: text of a passage; slot: is it a slot?"""

    token: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    slot: np.ndarray
    trusted: np.ndarray  # slots of a template syntax
    quoted: np.ndarray  # slots whose null literal is in quotation marks
    words: np.ndarray  # words per text
    spot: np.ndarray  # place of the passage's first character in its text
    size: np.ndarray  # and its length in characters


def _in(values: np.ndarray, few: tuple | list) -> np.ndarray:
    return np.isin(values, np.array([_word_hash(x) for x in few], np.uint64))


def passages(texts: list[str | None]) -> Passages:
    cp, cls, offsets = codepoints([t.lower() if t else "" for t in texts])
    none = np.zeros(0, np.int64)
    if not len(cp):
        return Passages(none.astype(np.uint64), none, none, none, none.astype(bool), none.astype(bool), none.astype(bool), np.zeros(len(texts), np.int64), none, none)
    new = run_starts(cls, offsets)
    other = cls == OTHER
    new[1:] |= other[1:] & (cp[1:] != cp[:-1])
    start = np.flatnonzero(new)
    ends = np.append(start[1:], len(cp))
    kind = cls[start]
    h = np.where(kind == NUMBER, NUMBER_HASH, hash_spans(cp, start))
    doc_of = np.searchsorted(offsets, start, side="right") - 1
    # White space makes no token, but borders.
    lines = np.concatenate([[0], np.cumsum(cp == 10)])
    is_space = kind == SPACE
    breaks = lines[ends] - lines[start]
    keep = np.flatnonzero(~is_space)
    before = np.zeros(len(start), np.int64)  # line breaks just before
    before[1:] = np.where(is_space[:-1], breaks[:-1], 0)
    gap = np.zeros(len(start), bool)
    gap[1:] = is_space[:-1]
    token, doc, kind = h[keep], doc_of[keep], kind[keep]
    before, gap, sign = before[keep], gap[keep], np.where(kind == OTHER, cp[start[keep]], 0)
    n = len(token)
    edge = np.zeros(n, bool)
    edge[0] = True
    edge[1:] = doc[1:] != doc[:-1]
    stop = np.isin(sign, [ord(c) for c in ".!?"])
    edge[1:] |= stop[:-1] & gap[1:]
    edge |= before >= 2
    opens = np.isin(sign, [ord("("), ord("[")])
    follows = np.append(kind[1:] == NUMBER, False)
    edge |= (before == 1) & ((kind == NUMBER) | (opens & follows))
    s_begin = np.flatnonzero(edge)
    s_end = np.append(s_begin[1:], n)
    # The number of a paragraph is no part of what it says.
    number = (kind == NUMBER) | np.isin(sign, [ord(c) for c in "()[]."])
    for _ in range(4):
        s_begin = np.where(number[s_begin] & (s_begin + 1 < s_end), s_begin + 1, s_begin)
    # What consists of such signs only is no sentence.
    said = np.append(0, np.cumsum(~number))
    says = said[s_end] > said[s_begin]
    # Slots.
    long_sign = ends[keep] - start[keep] >= 2
    odd = (kind == OTHER) & ((~np.isin(sign, [ord(c) for c in PROSE_SIGNS]) & ~np.isin(sign, [ord(c) for c in CLOSING])) | ((sign == ord("&")) & long_sign))
    literal = _in(token, NULL_LITERALS) & (kind == LETTER)
    form = _word_forms(sign, kind)
    at = np.flatnonzero(odd | literal | form)
    last = np.searchsorted(doc, doc[at], side="right")
    # Up to the closing sign if there is one soon; a literal stands for itself.
    closing = np.append(np.flatnonzero(np.isin(sign, [ord(c) for c in CLOSING + ")"])), n + 9)
    to = closing[np.searchsorted(closing, at)] + 1
    to = np.where(to - at <= 7, to, at + 3)
    l_begin, l_end = at, np.minimum(np.where(literal[at], at + 1, to), last)
    # A slot ends with its sentence.
    sentence = np.searchsorted(s_end, at, side="right")
    l_end = np.minimum(l_end, s_end[sentence])
    q = np.isin(sign, [ord(c) for c in QUOTES])
    near = np.append(False, q[:-1])[at] & np.append(q[1:], False)[at]
    trusted = _trusted_signs(sign, start[keep], ends[keep], at, odd) | (literal[at] & ~near)
    s_begin, s_end = s_begin[says], s_end[says]
    words = np.bincount(doc, weights=kind == LETTER, minlength=len(texts)).astype(np.int64)
    zero = np.zeros(len(s_begin), bool)
    b, e = np.concatenate([s_begin, l_begin]), np.concatenate([s_end, l_end])
    spot = start[keep[b]] - offsets[doc[b]]
    size = ends[keep[e - 1]] - start[keep[b]]
    return Passages(
        token, np.concatenate([s_begin, l_begin]), np.concatenate([s_end, l_end]), np.concatenate([doc[s_begin], doc[at]]), np.concatenate([zero, np.ones(len(at), bool)]),
        np.concatenate([zero, trusted]), np.concatenate([zero, literal[at] & near]), words, spot, size,
    )


def _word_forms(sign: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Opening brackets of forms like "(word: word)", with one to three words on either side."""
    n = len(sign)
    out = np.zeros(n, bool)
    opening = np.flatnonzero(sign == ord("("))
    for left in (1, 2, 3):
        for right in (1, 2, 3):
            o = opening[opening + left + right + 2 < n]
            ok = (sign[o + left + 1] == ord(":")) & (sign[o + left + right + 2] == ord(")"))
            for i in (*range(1, left + 1), *range(left + 2, left + right + 2)):
                ok &= kind[o + i] == LETTER
            out[o[ok]] = True
    return out


def _trusted_signs(sign: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Does the slot begin with a sign, or a pair of signs without space between, of a template syntax?"""
    nxt = np.minimum(at + 1, len(sign) - 1)
    glued = (start[nxt] == end[at]) & (nxt > at)
    out = np.zeros(len(at), bool)
    for t in TEMPLATE_SIGNS:
        a, b = ord(t[0]), ord(t[1]) if len(t) > 1 else 0
        long = end[at] - start[at] >= 2
        if a == b:
            out |= (sign[at] == a) & long
        else:
            out |= (sign[at] == a) & glued & (sign[nxt] == b)
    return out & odd[at]


def features(p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, passage of each): tokens and pairs of a passage, its borders taking part; slots apart from sentences."""
    size = p.end - p.begin
    which = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(p.begin, size)
    own = p.token[at]
    prev = np.append(BEGIN, own[:-1])
    prev[(ends - size)[size > 0]] = BEGIN
    space = np.where(p.slot[which], np.uint64(0x51ED270B), np.uint64(0))
    uni, pair = mix(own ^ space), mix(prev * np.uint64(0x9E3779B97F4A7C15) + own ^ space)
    close = np.flatnonzero(size > 0)
    tail = mix(p.token[p.end[close] - 1] * np.uint64(0x9E3779B97F4A7C15) + END ^ np.where(p.slot[close], np.uint64(0x51ED270B), np.uint64(0)))
    shift = np.uint64(64 - BITS)
    return (np.concatenate([uni, pair, tail]) >> shift).astype(np.int64), np.concatenate([which, which, close])


@dataclass
class Model:
    """Log odds per feature and the prior log odds, for sentences and slots."""

    odds: np.ndarray
    prior: tuple[float, float]

    def score(self, p: Passages) -> np.ndarray:
        f, which = features(p)
        total = np.bincount(which, weights=self.odds[f], minlength=len(p.begin))
        return total + np.where(p.slot, self.prior[1], self.prior[0])


def learn(texts: list[str | None], whole: list[bool] | None = None, extra: list[bool] | None = None, *, rounds: int = 4, short_words: int = 60, pull: float = 0.01, most: float = 0.02, common: float = 0.01) -> Model:
    """Expectation-maximization from trusted records; `pull` is the background's weight in the positive class, `most` the
    greatest prior share of residue among the passages. A feature that stands in more than the share `common` of the long
    records may be a heading of sound ones, which short records carry too. It speaks for residue if a wording of the list or a
    trusted slot has it, or if whole short records consist of such features and hold it more often than long ones do: what
    stands in a record regardless of its length makes up no greater share of the short ones. `whole` tells which texts are
    whole records (all, if not given): a part of a longer one is never a short record. `extra` tells which were sampled for
    their few characters: only the short ones by words among them count, as trusted records. They tell nothing of how often
    a feature stands in long records: on large tables they would be a third of those and make the commonest fillers common.
    """
    seeds = [*TRUSTED_TEXTS, *TRUSTED_SLOTS * SLOT_WEIGHT]
    n = 1 << BITS
    whole_of = np.ones(len(texts), bool) if whole is None else np.asarray(whole, bool)
    extra_of = np.zeros(len(texts), bool) if extra is None else np.asarray(extra, bool)
    at = 0
    parts, df, n_long, n_short, n_passages, n_docs = [], np.zeros(n, np.int64), 0, 0, 0, 0
    for i, chunk in enumerate([seeds, *_chunks(texts)]):  # a slice at a time: only the features are kept
        p = passages(chunk)
        f, which = features(p)
        given = np.full(len(p.begin), i == 0)
        is_short = (p.words > 0) & (p.words < short_words)
        is_long = p.words >= short_words
        if i:
            is_short &= whole_of[at : at + len(chunk)]
            left_out = extra_of[at : at + len(chunk)] & ~is_short
            is_long &= ~left_out
            at += len(chunk)
        short = is_short[p.doc] & ~given & ~p.slot
        is_slot_seed = (p.doc >= len(TRUSTED_TEXTS)) & given
        positive = (given & (p.slot == is_slot_seed)) | short | (p.trusted & ~given)
        take = (~given | positive) & ~p.quoted
        if i:
            take &= ~left_out[p.doc]
            of_long = is_long[p.doc[which]]
            df += np.bincount(np.unique(p.doc[which[of_long]] * n + f[of_long]) % n, minlength=n)
            n_long += int(is_long.sum())
            n_short += int(is_short.sum())
        usable = take[which]
        parts.append((f[usable].astype(np.int32), (which[usable] + n_passages).astype(np.int32), p.slot, given, positive, take, short, p.doc + n_docs))
        n_passages += len(p.begin)
        n_docs += len(chunk)
    f, which, slot, given, positive, take, short, doc = (np.concatenate(x) for x in zip(*parts))
    del parts
    is_common = df > max(5.0, common * n_long)
    told = _told_by_short(f, which, short, doc, is_common, df / max(n_long, 1), n_short)
    hard = given | (positive & slot)
    weight = positive.astype(np.float64)
    everything = np.bincount(f, minlength=n) + 0.0
    slot_f = slot[which]
    totals = [everything[np.unique(f[slot_f == k])].sum() if (slot_f == k).any() else 1.0 for k in (False, True)]
    kind_of = np.zeros(n, bool)
    kind_of[f[slot_f]] = True
    background = everything / np.where(kind_of, totals[1], totals[0])
    background = np.maximum(background, 0.5 / max(totals))
    model = None
    for _ in range(rounds):
        w = weight[which]
        pos = np.where(is_common & ~told, np.bincount(f, weights=w * hard[which], minlength=n), np.bincount(f, weights=w, minlength=n))
        size = [max(pos[~kind_of].sum(), 1.0), max(pos[kind_of].sum(), 1.0)]
        p1 = (1 - pull) * pos / np.where(kind_of, size[1], size[0]) + pull * background
        neg = np.maximum(everything - pos, 0.0)
        nsize = [max(neg[~kind_of].sum(), 1.0), max(neg[kind_of].sum(), 1.0)]
        p0 = 0.98 * neg / np.where(kind_of, nsize[1], nsize[0]) + 0.02 * background
        odds = np.log(p1) - np.log(p0)
        prior = []
        for k in (False, True):
            of = take & (slot == k) & ~given
            share = np.clip((weight[of].sum() + 0.5) / (of.sum() + 1.0), 1e-4, most)
            prior.append(float(np.log(share / (1 - share))))
        model = Model(odds.astype(np.float32), (prior[0], prior[1]))
        score = np.bincount(which, weights=model.odds[f], minlength=n_passages) + np.where(slot, prior[1], prior[0])
        weight = np.where(positive, 1.0, 1 / (1 + np.exp(-np.clip(score, -50, 50))))
    return model


def _told_by_short(f: np.ndarray, which: np.ndarray, short: np.ndarray, doc: np.ndarray, is_common: np.ndarray, rate: np.ndarray, n_short: int, most_rare: float = 0.2) -> np.ndarray:
    """Common features that short records hold more often, by chance's margin, than long ones. Only records made of common
    features throughout count: in others the rest is the residue, and the common part may be the heading above it."""
    size = np.bincount(which, minlength=len(short))
    rare = np.bincount(which, weights=~is_common[f], minlength=len(short))
    mixed = np.zeros(doc.max(initial=0) + 1, bool)
    mixed[doc[short & (rare > most_rare * size)]] = True
    of = (short & ~mixed[doc])[which]
    held = np.bincount(np.unique(doc[which[of]] * len(is_common) + f[of]) % len(is_common), minlength=len(is_common))
    chance = rate * n_short
    return is_common & (held > chance + 2 * np.sqrt(chance) + 2)


def _chunks(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str | None]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def records(texts: list[str | None], model: Model, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: best passage score (-inf without passages), passages that are residue, passages."""
    p = passages(texts)
    n = len(texts)
    best = np.full(n, -np.inf)
    if not len(p.begin):
        return best, np.zeros(n, np.int64), np.zeros(n, np.int64)
    score = np.where(p.quoted, -np.inf, model.score(p))
    np.maximum.at(best, p.doc, score)
    return best, np.bincount(p.doc[score > threshold], minlength=n), np.bincount(p.doc, minlength=n)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 2_000, sample_short: int = 2_000, short_chars: int = 1_000, part_chars: int = 200_000, salt: int = 29) -> Model:
    """The model from about sample_docs records of any length and sample_short records of at most short_chars characters,
    chosen by the hash of their id (the same on every run). Long records are taken in parts of part_chars, at most
    sample_docs parts in all. The texts are read once; without any text the list alone is learned.
    """
    n = docs.count()
    h = F.xxhash64(F.col(doc_id), F.lit(salt))
    # The least hashes: a share of the range of 64 bits, a third more than needed; all of a table not much larger.
    share = min(1.0, 4 / 3 * sample_docs / max(n, 1))
    near = h < F.lit(int(-(2**63) + share * (2**64 - 1))) if share < 1 else F.lit(True)
    short = F.length(text) <= short_chars
    rows = docs.where(F.col(text).isNotNull() & (near | short)).select(h.alias("h"), near.alias("near"), short.alias("short"), F.col(text).cast("string").alias("text"))
    rows = cut(rows)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length("text") - 1, F.lit(0)).cast("long"), F.lit(part_chars).cast("long"))
    parts = rows.where("near").withColumn("at", F.explode(starts)).select(F.xxhash64("h", "at").alias("k"), F.expr(f"substring(text, int(at) + 1, {part_chars})").alias("part"), (F.length("text") <= part_chars).alias("whole"))
    some = parts.orderBy("k").limit(sample_docs).collect()
    if n and not some and not rows.isEmpty():
        raise RuntimeError("the sample for the fit is empty")
    few = rows.where("short and not near").orderBy("h", "text").limit(sample_short).collect()
    texts = [(*x, False) for x in sorted((r["part"], r["whole"]) for r in some)] + [(r["text"], True, True) for r in few]
    return learn(*(list(x) for x in zip(*texts))) if texts else learn([])


def residue(docs: DataFrame, model: Model | None = None, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.0) -> DataFrame:
    """(doc_id, score, residue_passages, passages) of the records that hold residue. Without a model one is fitted first.

    Null and empty texts hold none. Repeated records are each reported. Texts are taken whole. Other columns are ignored.
    """
    model = model or fit(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, fixed by BITS
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr = batch.column(1)
            for lo, hi in slices(arr):
                best, bad, every = records(arr.slice(lo, hi - lo).to_pylist(), shared.value, threshold)
                hit = np.flatnonzero(bad > 0)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit + lo)), pa.array(best[hit]), pa.array(bad[hit]), pa.array(every[hit])], names=[doc_id, "score", "residue_passages", "passages"])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(run, f"`{doc_id}` {kind}, score double, residue_passages long, passages long")
