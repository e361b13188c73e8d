"""Mixing sources to target weights: Sainte-Lague apportionment, in DataFrame functions only.

All words are shared out by source weight; a source's target stops at ``cap`` times its size and the
excess goes to the others by weight. Targets become blocks of equally many words by Sainte-Lague
(highest quotients target / (2 s + 1)), first over sources, then over the groups of shards of each
source, then over the shards of each group. A shard's documents lie in a seeded order; its quota of
blocks is taken from the start of that stream, whole passes over the shard first. A large source
has many shards and these many groups, so no task holds a source or all its shards. The order
comes from doc_id and text, so rows that share a doc_id, null among them, are spread as well.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source, last in
order; repeated rows count each; an empty table gives no rows; other columns are ignored or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import WORD_BREAK, dropped, staged

WEIGHTS = (1, 2, 3)


def count_words(text: Column) -> Column:
    words = F.size(F.array_remove(F.split(text, WORD_BREAK), ""))
    return F.when(text.isNull(), 0).otherwise(words).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with source_no, weight and target.

    In ascending order of cap / weight the capped sources come first; each is capped if its cap is
    at most its share of what the ones before it leave.
    """
    ranked = sources.withColumn("source_no", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    order = W.orderBy(F.col("most") / F.col("weight"), "source_no")
    before, all_ = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    ranked = ranked.withColumns(
        {
            "total": F.sum("source_size").over(all_),
            "weights": F.sum("weight").over(all_),
            "most_before": F.coalesce(F.sum("most").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    left = (F.col("total") - F.col("most_before")) * F.col("weight") / (F.col("weights") - F.col("weight_before"))
    ranked = ranked.withColumn("capped", F.col("most") <= left)
    ranked = ranked.withColumns(
        {
            "spent": F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(all_), F.lit(0)),
            "spent_weight": F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(all_), F.lit(0)),
        }
    )
    share = (F.col("total") - F.col("spent")) * F.col("weight") / (F.col("weights") - F.col("spent_weight"))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share)
    return ranked.select("source", "source_no", "source_size", "weight", target.alias("target"), "total")


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the seats of each group by highest quotients, ties to smaller keys. Group and party keys are not null.

    The rounded quotas differ from the result by the group's surplus. With P parties, V votes and a surplus D a party of
    v votes gains or loses at most v (|D| + P) / V + 1 seats, so only so many of its quotients are ranked: some three a party.
    """
    keys = list(dict.fromkeys(group + party))
    parties = staged(parties, "mix-parties")  # it is read several times
    v, n = F.col(votes).cast("double"), F.col(seats)
    totals = parties.groupBy(*group).agg(F.sum(v).alias("_v"), F.count(F.lit(1)).alias("_p"))
    start = parties.join(totals, group)
    start = start.withColumn("_r", F.when(F.col("_v") > 0, F.floor(v * n / F.col("_v") + 0.5)).otherwise(0).cast("long"))
    start = staged(start, "mix-start")
    dropped(parties)
    given = start.groupBy(*group).agg(F.sum("_r").alias("_given"))
    start = start.join(given, group).withColumn("_d", F.when(F.col("_v") > 0, n - F.col("_given")).otherwise(0).cast("long"))
    most = F.least(F.abs("_d"), (F.floor(v * (F.abs("_d") + F.col("_p")) / F.col("_v")) + 2).cast("long"))
    more = start.filter("_d != 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    seat = F.when(F.col("_d") > 0, F.col("_r") + F.col("_k") - 1).otherwise(F.col("_r") - F.col("_k"))
    more = more.withColumn("_s", seat).filter("_s >= 0").withColumn("_q", v / (2 * F.col("_s") + 1))
    sign = F.signum("_d")
    # ties: added seats go to smaller keys first, taken ones from larger keys
    more = more.withColumn("_n", F.dense_rank().over(W.partitionBy(*group).orderBy(*party)))
    best = W.partitionBy(*group).orderBy(-sign * F.col("_q"), sign * F.col("_n"), sign * F.col("_s"))
    more = more.withColumn("_b", F.row_number().over(best)).filter("_b <= abs(_d)")
    change = more.groupBy(*keys).agg(F.sum(sign).cast("long").alias("_c"))
    joined = start.join(change, keys, "left")
    return joined.withColumn("quota", F.col("_r") + F.coalesce("_c", F.lit(0))).drop("_r", "_d", "_c", "_v", "_p", "_given")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = 3, block: int = 8, shard_words: int = 1 << 17, group_shards: int = 1 << 12, seed: str = "mix", carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shard) of all documents.

    block: words in a block. shard_words: about so many words of a source make a shard. group_shards: about so many
    shards of a source share out the quota of a group. carry: all columns of ``docs`` come along as the struct ``carried``.
    """
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")] if carry else []
    sized = staged(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), order.alias("_o"), *carried), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = sources.withColumns({"_all": F.lit(0), "_seats": F.round(F.col("total") / block).cast("long")})
    sources = sainte_lague(sources, ["_all"], ["source_no"], "target", "_seats").withColumnRenamed("quota", "source_quota")
    sources = staged(sources.select("source", "source_no", "source_size", "target", "source_quota"), "mix-sources")
    number = F.conv(F.substring("_o", 1, 8), 16, 10).cast("long")
    placed = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    shards_of = 1 + F.floor(F.col("source_size") / shard_words)
    placed = placed.withColumn("shard", number % shards_of)
    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("source_size").alias("source_size"))
    shards = staged(shards.withColumn("shards", F.col("shard") % (1 + F.floor(shards_of / group_shards))), "mix-shards")
    parts = shards.groupBy("source_no", "shards").agg(F.sum("shard_size").alias("part_size"), F.first("source_quota").alias("_seats"))
    parts = sainte_lague(parts, ["source_no"], ["shards"], "part_size", "_seats").select("source_no", "shards", F.col("quota").alias("_seats"))
    quotas = sainte_lague(shards.join(parts, ["source_no", "shards"]), ["source_no", "shards"], ["shard"], "shard_size", "_seats")
    quotas = staged(quotas.select("source_no", "shard", "shard_size", (F.col("quota") * block).alias("quota_words")), "mix-quotas")
    dropped(shards)
    stream = W.partitionBy("source_no", "shard").orderBy("_o", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(stream)).join(quotas, ["source_no", "shard"])
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota_words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("quota_words") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("size")))
    taken = F.least(passes * F.col("size") + part, F.col("size") * cap).cast("long")
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "shard", *(["carried"] if carry else []))
