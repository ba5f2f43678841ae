"""Mixing sources to target weights (problem 9).

Method: every source is cut by the hash of the record id into blocks of about `block_tokens` tokens, at every size of
the corpus. The plan fixes how many blocks of each source are drawn, full passes and a partial one, never more passes
than allowed. A multivariate-hypergeometric splitting tree divides these exact quotas among the output shards: each node
draws the left half's share of every source without replacement and leaves the rest to the right half. The drawn blocks
of a source, in permuted order, are dealt out along the shards' quotas, so they are disjoint; a record's place within
its shard comes from a hash, a local shuffle. What a source lacks is read from the blocks that were dealt.

Scale: the only figures on the driver are those per source and shard (both counts checked). Blocks are rows of a table
(source, block, tokens), summed with map-side combine; their permutation uses bucketed ranks, so a source with most of
all rows is as many keys as its share of the blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_hex, norm_category
from ..operators.ranking import ranked_by_hash
from ..session import cut
from .tokens import token_counts

MOST_SOURCES = 100_000


@dataclass
class SourcePlan:
    source: str
    target_permille: int
    max_repeats: int
    docs: int
    tokens: int
    wanted: float  # tokens
    cells: int  # by hash
    blocks: int  # cells that hold records
    draws: int  # blocks drawn, repeats counted


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources counts: columns add up to the quotas, rows to even parts of their sum."""
    if sum(quotas) >= 10**9:
        raise ValueError("more than 10**9 blocks drawn; take larger blocks")
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, left_over: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = left_over
            return
        mid = (lo + hi) // 2
        take = int(left_over.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        part = np.zeros_like(left_over)
        need, rest = take, int(left_over.sum())
        for i, have in enumerate(left_over.tolist()):  # marginals one after the other
            rest -= have
            part[i] = rng.hypergeometric(have, rest, need) if have and need and rest else min(have, need) if not rest else 0
            need -= int(part[i])
        node(lo, mid, part)
        node(mid, hi, left_over - part)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


class Mixture:
    """The mixture of `docs` by `targets`; see plan(), shares() and records().

    Source names are compared as categories (trimmed, lower case, blanks and hyphens as underscores). Records of sources
    without a target, or without a source, count in the total but aren't drawn. Null and empty texts have no tokens and
    go with their block. A target named twice has its greatest permille and repeats. Without records or tokens nothing
    is wanted and nothing drawn. With `words` sizes are ASCII words, not tokens of the vocabulary. With `hold_shares` the
    whole is made smaller, until every source that may give anything can give its share of it; else a source that is too
    small gives all it may.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str | None = None, words: bool = False, hold_shares: bool = False, shards: int = 16, block_tokens: int = 4_096, seed: int = 17) -> None:
        self.spark, self.doc_id, self.shards, self.seed = docs.sparkSession, doc_id, shards, seed
        if words:
            sized = docs.select(doc_id, source, F.coalesce(F.regexp_count(text, F.lit("[A-Za-z0-9_]+")), F.lit(0)).cast("long").alias("tokens"))
        else:
            sized = token_counts(docs, [doc_id, source], text, vocabulary=vocabulary)
        self.sized = cut(sized.select(F.col(doc_id).alias("id"), norm_category(f"`{source}`").alias("source"), "tokens"))
        t = targets.select(norm_category("source").alias("source"), "target_permille", "max_repeats").where("source is not null")
        t = t.groupBy("source").agg(F.max(F.coalesce("target_permille", F.lit(0))).alias("permille"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats"))
        per = self.sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
        wanted_of = t.orderBy("source").limit(MOST_SOURCES + 1).collect()
        if len(wanted_of) > MOST_SOURCES:
            raise ValueError("too many sources")
        sums = {r["source"]: r for r in per.join(F.broadcast(t.select("source")), "source", "left_semi").collect()}
        rows = [(r["source"], r["permille"], r["repeats"], sums[r["source"]]["docs"] if r["source"] in sums else 0, (sums[r["source"]]["tokens"] or 0) if r["source"] in sums else 0) for r in wanted_of]
        self.total = self.sized.agg(F.sum("tokens")).first()[0] or 0
        whole = self.total
        if hold_shares:
            whole = min([self.total, *[repeats * tokens * 1000 // permille for _, permille, repeats, _, tokens in rows if permille * repeats * tokens]])
        self.sources = [SourcePlan(name, permille, repeats, n, tokens, permille * whole / 1000, -(-tokens // block_tokens), 0, 0) for name, permille, repeats, n, tokens in rows]
        self.blocks = cut(self._blocked().groupBy("source", "block").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
        found = {r["source"]: r["count"] for r in self.blocks.groupBy("source").count().collect()}  # a row per target source
        for s in self.sources:  # blocks that hold records; others have nothing to draw
            s.blocks = found.get(s.source, 0)
            s.draws = min(s.max_repeats * s.blocks, int(s.wanted / s.tokens * s.blocks + 0.5)) if s.tokens else 0

    def plan(self) -> DataFrame:
        """One row per target source: sizes, what is wanted, blocks and draws."""
        rows = [(s.source, s.target_permille, s.max_repeats, s.docs, s.tokens, s.wanted, s.blocks, s.draws) for s in self.sources]
        return self.spark.createDataFrame(rows, "source string, target_permille long, max_repeats long, docs long, tokens long, wanted_tokens double, blocks long, draws long")

    def draws(self) -> DataFrame:
        """The drawn blocks: (source, block, copy, shard, docs, tokens); a copy of a source has each block at most once."""
        some = [s for s in self.sources if s.draws]
        quotas = np.cumsum(split_quotas([s.draws for s in some], self.shards, self.seed), axis=0) if some else np.zeros((self.shards, 0))
        rows = [(s.source, s.blocks, s.draws, quotas[:, i].tolist()) for i, s in enumerate(some)]
        per = self.spark.createDataFrame(rows, "source string, blocks long, draws long, upto array<long>")
        copies = F.sequence(F.lit(0), F.expr("cast((draws - 1) div blocks AS int)"))
        each = self.blocks.withColumnRenamed("docs", "n_docs").join(F.broadcast(per), "source").withColumn("copy", F.explode(copies))
        key = [F.col("source"), F.col("copy").cast("string"), F.col("block").cast("string")]
        each = ranked_by_hash(each.withColumn("h", hash_hex(f"pass-{self.seed}", *key)), ["source", "copy"], "h", ["block"], name="nth")
        each = each.where(F.col("nth") + F.col("copy") * F.col("blocks") <= F.col("draws"))
        each = ranked_by_hash(each.withColumn("h", hash_hex(f"deal-{self.seed}", *key)), ["source"], "h", ["copy", "block"], name="place")
        return each.select("source", "block", "copy", F.size(F.filter("upto", lambda x: x < F.col("place"))).alias("shard"), F.col("n_docs").alias("docs"), "tokens")

    def _blocked(self) -> DataFrame:
        cells = self.spark.createDataFrame([(s.source, s.cells) for s in self.sources if s.cells], "source string, cells long")
        at = F.conv(F.substring(hash_hex(f"block-{self.seed}", F.col("id").cast("string")), 1, 15), 16, 10).cast("long")
        return self.sized.join(F.broadcast(cells), "source").withColumn("block", at % F.col("cells")).drop("cells")

    def records(self) -> DataFrame:
        """The mixture, one row per record and copy: (id, source, copy, shard, place_key); sort a shard by place_key."""
        out = self._blocked().join(self.draws().drop("docs", "tokens"), ["source", "block"])
        key = hash_hex(f"shuffle-{self.seed}", F.col("id").cast("string"), F.col("copy").cast("string"))
        return out.select(F.col("id").alias(self.doc_id), "source", "copy", "shard", key.alias("place_key"))

    def shares(self) -> DataFrame:
        """plan() with what was dealt: tokens, the most copies of a record, the shares reached (permille of what was drawn,
        and of all tokens) and `short`: every copy allowed was drawn and the tokens are still below the target."""
        shard = self.draws().groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.max("copy").alias("copy"))
        drawn = shard.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.sum("n").alias("drawn_blocks"), (F.max("copy") + 1).alias("most_copies"))
        out = self.plan().join(drawn, "source", "left").fillna({"drawn_tokens": 0, "drawn_blocks": 0, "most_copies": 0})
        all_drawn = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per target source
        share = lambda whole: F.round(F.when(whole > 0, F.col("drawn_tokens") * 1000 / whole).otherwise(0.0), 3)
        all_copies = F.col("drawn_blocks") >= F.col("max_repeats") * F.col("blocks")
        short = all_copies & (F.col("drawn_tokens") * 1000 < F.col("target_permille") * F.lit(self.total))
        return out.withColumn("reached_permille", share(all_drawn)).withColumn("of_all_permille", share(F.lit(self.total))).withColumn("short", short)
