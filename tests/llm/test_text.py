"""Problems 8, 9 and 10."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomyard.llm import leakage, mixing, queries, residue, textvec, tokens

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(RNG.randrange(3, 9))) for _ in range(4000)]


def prose(n, seed):
    return [random.Random(seed * 100003 + i).choice(WORDS) for i in range(n)]


def test_word_hashes_follow_words_only():
    a = pa.array(["The  CAT,sat", "the cat–sat", None, "", "cat", "x" * 200 + " cat"])
    h, off = textvec.words(a)
    rows = [h[off[i] : off[i + 1]].tolist() for i in range(len(a))]
    assert rows[0] == rows[1] and len(rows[0]) == 3 and rows[2] == rows[3] == [] and rows[4][0] == rows[0][1] == rows[5][1]
    long = " ".join(prose(900_000, 1))
    assert len(textvec.words(pa.array([long]))[0]) == 900_000


def test_passages_are_found_damaged_cut_and_interrupted(spark):
    item = prose(150, 2)
    short = prose(40, 3)
    fill = lambda k: prose(300, 50 + k)
    damaged = [w if i % 12 else "zzz" for i, w in enumerate(item)]
    docs = {
        1: fill(1) + item + fill(2), 2: fill(3) + damaged + fill(4), 3: fill(5) + item[60:100] + fill(6),
        4: fill(7) + item[:50] + prose(25, 99) + item[50:] + fill(8), 5: fill(9) + item[20:45] + fill(10), 6: fill(11), 7: short, 8: item[:39],
    }
    rows = [(k, " ".join(v).upper() if k % 2 else "\n".join(v), "x") for k, v in docs.items()] + [(1, " ".join(docs[1]), "x"), (20, None, "x"), (21, "", "x"), (22, "\n".join(fill(12) * 500 + item), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "four words only here")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_passages(d, i, doc_id="doc_id", item_id="item_id").collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (7, 2), (22, 1)]
    blocks = sorted((r.doc_id, r.item_id) for r in leakage.leaked_passages(d, i, doc_id="doc_id", item_id="item_id", block_words=60).collect())
    assert blocks == got
    assert leakage.leaked_passages(d.limit(0), i, doc_id="doc_id", item_id="item_id").count() == 0
    assert leakage.leaked_passages(d, i.limit(0), doc_id="doc_id", item_id="item_id").count() == 0


def test_search_misses_nothing_brute_force_finds(small):
    import pyarrow.parquet as pq

    docs, items = pq.read_table(f"{small}/documents.parquet")["text"], pq.read_table(f"{small}/eval_item.parquet")
    index = leakage.ItemIndex(items["item_id"].to_pylist(), items["text"].to_pylist())
    arr = docs.combine_chunks()
    got = {(r, i) for r, i, *_ in leakage.search(arr, index)}
    h, off = textvec.words(arr)
    s, so = textvec.shingles(h, off, leakage.K)
    every = set()
    for r in range(len(arr)):
        p, item, q = index.postings(*index.lookup(s[so[r] : so[r + 1]]))
        for i in np.unique(item):
            own = index.words[index.offsets[i] : index.offsets[i + 1]]
            if leakage.best_chain(p[item == i], q[item == i], min(40, int(index.length[i])), 0.65, index.rare[index.start[i] + q[item == i]], h[off[r] : off[r + 1]], own):
                every.add((r, int(i)))
    assert len(every) > 0 and got == every


def test_token_counts_are_those_of_the_tokenizer():
    c = tokens.TokenCounter(tokens.default_vocabulary())
    rng = random.Random(1)
    parts = ["'s", "'re", "'", "''", " ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "7", "!", "…", "'ll", "'llx", "'d", "日本", "😀", " '", "it's", "x'"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4)]
        assert c.counts(texts).tolist() == [len(c.encoding.encode_ordinary(t)) for t in texts]
    assert c.counts([None, "", "a" * 500_000]).tolist()[:2] == [0, 0]


def test_splitting_tree_is_exact_and_stable():
    q = [7, 0, 100, 1, 33]
    a = mixing.split_quotas(q, 6, 3)
    assert a.sum(0).tolist() == q and a.sum(1).max() - a.sum(1).min() <= 2 and (a >= 0).all()
    assert (a == mixing.split_quotas(q, 6, 3)).all() and (a != mixing.split_quotas(q, 6, 4)).any()


def test_mixture_reaches_shares_within_the_cap(spark):
    rows = [(i, "Big-one" if i % 2 else " BIG_ONE", "word " * 40) for i in range(400)] + [(1000 + i, "small", "word " * 40) for i in range(20)] + [(2000, "tiny", "word " * 40), (2001, None, "word"), (2002, "small", None), (2003, "small", "")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit(1)).withColumn("copy", F.lit(1))
    t = spark.createDataFrame([("big_one", 700, 1), ("Small", 200, 10), ("tiny", 100, 3), ("absent", 0, 1)], "source string, target_permille long, max_repeats long")
    m = mixing.Mixture(d, t, shards=4, block_tokens=120)
    plan = {r.source: r for r in m.plan().collect()}
    recs = m.records().collect()
    assert len({(r.doc_id, r["copy"]) for r in recs}) == len(recs)
    assert all(r["copy"] < plan[r.source].max_repeats for r in recs) and {r.shard for r in recs} == {0, 1, 2, 3}
    shares = {r.source: r for r in m.shares().collect()}
    assert [k for k, r in shares.items() if r.short] == ["tiny"] and shares["tiny"].drawn_blocks == 3 * plan["tiny"].blocks
    held = {r.source: r for r in mixing.Mixture(d, t, shards=4, block_tokens=120, hold_shares=True).shares().collect()}
    assert all(abs(held[k].reached_permille - plan[k].target_permille) < 150 for k in held) and held["big_one"].drawn_tokens < shares["big_one"].drawn_tokens
    assert abs(shares["big_one"].drawn_tokens - plan["big_one"].wanted_tokens) < 0.1 * plan["big_one"].wanted_tokens
    assert abs(shares["small"].drawn_tokens - plan["small"].wanted_tokens) < 0.25 * plan["small"].wanted_tokens
    assert shares["tiny"].drawn_tokens == 3 * plan["tiny"].tokens
    again = mixing.Mixture(d.repartition(5), t, shards=4, block_tokens=120)
    assert sorted(map(tuple, again.records().collect())) == sorted(map(tuple, recs))
    for docs, targets in ((d.limit(0), t), (d, t.limit(0))):
        e = mixing.Mixture(docs, targets)
        assert e.records().count() == 0 and e.shares().count() == targets.count()


def test_short_sources_are_read_from_the_dealt_blocks(spark, small):
    """Ranks of the draw, quotas of the tree and sums of blocks are all part of the plan of p9_found."""
    plan = queries.p9_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" in plan and "upto" in plan and "sum(tokens" in plan


CLEAN = "The tribunal found that the ledger was kept in order and dismissed the claim with costs of 1,200 crowns. "
BAD = ["404 Not Found", "Please enable JavaScript to view this decision.", CLEAN * 30 + "\n\n4. Lorem ipsum dolor sit amet consectetur.\n\n" + CLEAN * 20, CLEAN * 20 + "The claimant {{ claimant_name }} appeared. " + CLEAN * 20, CLEAN * 30 + "Decided undefined\n" + CLEAN * 20, CLEAN * 40 + "\n\nService temporarily unavailable"]
GOOD = [CLEAN * 30, CLEAN * 20 + "[REDACTED] and [sic] appear. " + CLEAN * 20, CLEAN * 20 + 'The system printed "undefined" on 37 receipts, and the tribunal was shown each. ' + CLEAN * 20, CLEAN * 20 + "The respondent's shop required customers to enable JavaScript, a term which the tribunal found was never explained. " + CLEAN * 20, "", None]


def test_residue_is_told_from_evidence_and_redaction(spark):
    filler = [(1000 + i, CLEAN * 30 + f"The respondent's shop required customers to enable JavaScript, a term which witness {i} never explained. The order [2019] was [REDACTED] here.") for i in range(60)]
    rows = [(i, t) for i, t in enumerate(BAD)] + [(100 + i, t) for i, t in enumerate(GOOD)] + filler + [(0, BAD[0]), (7, CLEAN * 60_000 + "\n\nLorem ipsum dolor sit amet.\n\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    got = residue.residue(d).collect()
    assert sorted(r.doc_id for r in got) == [0, 0, 1, 2, 3, 4, 5, 7]
    assert residue.residue(d.limit(0)).count() == 0


def test_held_out_accuracy(small):
    """Trained on one scale, judged on the marked wordings of another."""
    import re

    import pyarrow.parquet as pq

    train = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    texts = pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()
    model = residue.learn(train)
    _, bad, _ = residue.records(texts, model)
    sure = re.compile(r"lorem ipsum|\{\{|\$\{|<%=|asdf|Reference source not found|^\s*(404|502|503|HTTP \d)", re.I | re.M)
    marked = [i for i, t in enumerate(texts) if t and sure.search(t)]
    assert all(bad[i] > 0 for i in marked) and (bad > 0).sum() < 0.12 * len(texts)
