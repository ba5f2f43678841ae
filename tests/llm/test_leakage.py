"""Problem 8: leaks that a cut of candidates or of chains would lose."""

import random

import pyarrow as pa
import pytest

from loomyard.llm import leakage

from .test_text import prose


def found(docs, items):
    index = leakage.ItemIndex(list(range(len(items))), [" ".join(x) for x in items])
    return sorted((r, i) for r, i, *_ in leakage.search(pa.array([" ".join(x) for x in docs]), index))


@pytest.mark.parametrize("block_words", [4_000_000, 200])
def test_items_listed_again_or_sharing_a_passage_are_found(spark, block_words):
    common = prose(60, 201)
    items = [(i, " ".join(prose(120, 200))) for i in range(3)] + [(3, " ".join(prose(120, 200)).upper() + ".")]
    items += [(10 + k, " ".join(prose(40, 210 + k) + common + prose(40, 220 + k))) for k in range(4)]
    broken = [w if i % 8 else "zzz" for i, w in enumerate(common[:48])]
    docs = {1: prose(200, 230) + prose(120, 200)[30:90] + prose(200, 231), 2: prose(200, 232) + common + prose(200, 233), 3: prose(200, 234) + broken + prose(100, 235), 4: prose(300, 236)}
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_passages(d, i, doc_id="doc_id", item_id="item_id", block_words=block_words).collect())
    assert got == [(1, k) for k in range(4)] + [(n, 10 + k) for n in (2, 3) for k in range(4)]


def test_stock_phrases_of_many_items_are_no_case():
    phrases = [prose(9, 240 + k) for k in range(4)]
    items = [sum((x + prose(2, 250 + 10 * k + j) for j, x in enumerate(phrases)), prose(40, 260 + k)) + prose(40, 270 + k) for k in range(5)]
    assert found([prose(100, 280) + sum((x + prose(2, 300 + j) for j, x in enumerate(phrases)), []) + prose(100, 281)], items) == []


@pytest.mark.parametrize("lost", [(25,), (34,), (24, 26), (29, 30), (24, 35)])
def test_damage_beside_an_insertion_breaks_no_case(lost):
    item = prose(60, 400)
    hurt = ["zzz" if i in lost else w for i, w in enumerate(item)]
    assert found([prose(100, 401) + hurt[:30] + prose(20, 402) + hurt[30:] + prose(100, 403)], [item]) == [(0, 0)]


@pytest.mark.parametrize("foreign", [119, 121, 3000])
def test_insertions_of_any_length_break_no_case(foreign):
    item = prose(76, 410)
    assert found([prose(100, 411) + item[:38] + prose(foreign, 412) + item[38:] + prose(100, 413)], [item]) == [(0, 0)]


def test_every_sixth_word_damaged_is_always_proposed():
    items = [prose(150, 420 + k) for k in range(40)]
    docs = [prose(150, 500 + k) + [w if i % 6 < 5 else "zzz" for i, w in enumerate(x[40:100])] + prose(150, 550 + k) for k, x in enumerate(items)]
    assert found(docs, items) == [(k, k) for k in range(40)]


def share_found(make, n: int = 60) -> float:
    """Planted passages that are found; the planting knows nothing of the operator's rules. None may be found elsewhere."""
    rng = random.Random(5)
    items = [prose(150, 600 + k) for k in range(n)]
    docs = [prose(120, 700 + k) + make(rng, x) + prose(120, 800 + k) for k, x in enumerate(items)]
    got = found(docs, items)
    assert all(r == i for r, i in got)
    return len(got) / n


@pytest.mark.parametrize(("words", "damaged", "least"), [(40, 0, 1.0), (40, 1, 0.9), (40, 2, 0.85), (45, 1, 0.95), (45, 3, 0.9), (60, 3, 1.0)])
def test_recall_of_damaged_passages(words, damaged, least):
    """A passage of 40 words whose first or last word is damaged can't be told from 39 quoted words; hence not 1."""

    def make(rng, item):
        at = rng.randrange(len(item) - words)
        part = item[at : at + words]
        for j in rng.sample(range(words), damaged):
            part[j] = "zzz"
        return part

    assert share_found(make) >= least


@pytest.mark.parametrize("foreign", [50, 130, 500, 2000])
def test_recall_of_passages_with_insertions(foreign):
    def make(rng, item):
        at, cut = rng.randrange(90), rng.randrange(10, 50)
        return item[at : at + cut] + prose(foreign, 900 + at) + item[at + cut : at + 60]

    assert share_found(make) >= 0.9


def test_an_item_three_times_in_the_set_is_found_each_time():
    item = prose(120, 950)
    assert found([prose(90, 951) + item[20:80] + prose(90, 952)], [item, item, item]) == [(0, 0), (0, 1), (0, 2)]
