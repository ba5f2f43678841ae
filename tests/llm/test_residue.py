"""Problem 10: residue so frequent that its wording is common in long records too."""

import random

import pytest

from loomyard.llm import residue

from .test_text import prose

NOTICE = "Kindly refresh this window, as the archive viewer was not able to fetch the ruling you selected."
HEADING = "Supreme Tribunal of the Northern Province, Reports of Decisions"


def corpus(every: int):
    rng = random.Random(3)
    # Sound records of all lengths bear the heading; also the short ones.
    long = [f"{HEADING}\n\n" + ". ".join(" ".join(prose(14, 1000 + 20 * k + j)) for j in range(15)) + "." for k in range(300)]
    hot = [k for k in range(len(long)) if k % every == 0]
    texts = [x + f"\n\n{NOTICE}\n\n" + " ".join(prose(40, 9000 + k)) + "." if k in hot else x for k, x in enumerate(long)]
    pages = [NOTICE] * 40 + [f"{HEADING}\n\nError {rng.randrange(400, 600)}. Page not found."] * 8
    return texts + pages, hot, range(len(texts), len(texts) + len(pages))


@pytest.mark.parametrize("every", [3, 30])
def test_a_hot_unlisted_notice_is_found_and_headings_are_not(every):
    texts, hot, pages = corpus(every)
    _, bad, _ = residue.records(texts, residue.learn(texts))
    assert {i for i in range(len(texts)) if bad[i] > 0} == {*hot, *pages}


def test_a_hot_template_slot_is_found():
    texts = [". ".join(" ".join(prose(14, 5000 + 20 * k + j)) for j in range(15)) + "." for k in range(150)]
    texts = [x + " The appellant &&appellant_reference&& appeared." if k % 3 == 0 else x for k, x in enumerate(texts)]
    _, bad, _ = residue.records(texts, residue.learn(texts))
    assert [k for k in range(len(texts)) if bad[k] > 0] == list(range(0, 150, 3))


def test_wordings_of_no_list_are_learned_from_short_records():
    """Forty notices that neither the list nor any long record of the fit holds; each is a short record twice. Measured on
    other long records: recall and precision at least 0.9."""
    rng = random.Random(8)
    notices = [f"The {a} of {b} could not be {c}, so nothing is shown." for a, b, c in zip(prose(40, 70), prose(40, 71), prose(40, 72))]
    decision = lambda k: ". ".join(" ".join(prose(14, 7000 + 20 * k + j)) for j in range(12)) + "."
    model = residue.learn([decision(k) for k in range(250)] + [x for x in notices for _ in range(2)])
    held = [decision(2000 + k) for k in range(160)]
    texts = [f"{x}\n\n{notices[k // 2]}\n\n{decision(4000 + k)}" if k < 80 else x for k, x in enumerate(held)]
    rng.shuffle(texts)
    _, bad, _ = residue.records(texts, model)
    found, true = {i for i in range(160) if bad[i] > 0}, {i for i, x in enumerate(texts) if any(n in x for n in notices)}
    assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.9 * len(found)


def test_the_fit_takes_long_records_in_parts_and_short_ones_besides(spark):
    long = ". ".join(" ".join(prose(14, 8000 + j)) for j in range(400)) + "."
    rows = [(i, long) for i in range(6)] + [(100 + i, NOTICE) for i in range(4)] + [(200, None), (201, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = residue.fit(d, sample_docs=3, sample_short=4, short_chars=200, part_chars=5_000)
    assert {r.doc_id for r in residue.residue(d, model).collect()} == {100, 101, 102, 103}
    assert residue.residue(d.limit(0)).count() == 0


def test_short_records_of_many_words_make_no_filler_common(spark):
    """Unlisted fillers in stubs of few characters, half of them of 60 words and more. The stubs are sampled besides, as on a
    large table; were they counted as long records, their wordings would be common ones and lost in decisions."""
    rng = random.Random(4)
    fillers = [" ".join(prose(8, 300 + k)) + "." for k in range(60)]
    decision = lambda k: ". ".join(" ".join(prose(14, 20_000 + 20 * k + j)) for j in range(20)) + "."
    rows = [(k, decision(k) + (f"\n\n{fillers[k // 15]}\n\n" + decision(900 + k) if k % 15 == 0 else "")) for k in range(900)]
    rows += [(1000 + k, "\n\n".join(rng.choices(fillers, k=5 if k % 2 else 9))) for k in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in residue.residue(d, residue.fit(d, sample_docs=200)).collect()}
    assert found <= {*range(0, 900, 15), *range(1000, 1100)}
    assert len(found & {*range(0, 900, 15)}) >= 20  # 7 where they counted as long


def test_a_passage_of_bracketed_numbers_says_nothing():
    p = residue.passages(["[12]\n\nThe appeal is dismissed.\n\n(3) [4]\n\n[●]"])
    assert [int(n) for n in (p.end - p.begin)[~p.slot]] == [5, 2]
