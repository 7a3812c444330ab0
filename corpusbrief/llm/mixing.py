"""Mixing sources to target weights: whole copies first, then a Pareto order sample for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import landed
from .texts import quoted, table_operator

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BINS = 1 << 16
COLUMNS = ["source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def brevity(size: Column) -> Column:
    """A preference for short documents within their source, from 100 for a few words to 1 from 991 words on: more
    different documents for the same words. Whole numbers, so that their sums don't depend on the order."""
    return F.greatest(F.lit(1), F.floor(F.lit(1000) / (size + 10))).cast("long")


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number strictly between 0 and 1 that depends on the keys alone: 52 bits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, get the weights in turn. Targets add up to ``share`` of all sizes and stop
    at ``most`` times the source's; what is over is shared out again among the others until none is above. So the
    targets are min(most * size, level * weight), and each round fixes the sources that are above the level.
    """
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    placed = numbered(sources, order, "__at", start=0)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    weighed = landed(placed.withColumn("__weight", cycle).withColumn("__cap", F.col("source_size") * F.lit(float(most))))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        above = F.col("__cap") <= F.lit(level) * F.col("__weight")
        fixed, open_ = weighed.agg(
            F.coalesce(F.sum(F.when(above, F.col("__cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("__weight"))), F.lit(0.0))
        ).first()
        raised = (share * total - fixed) / open_ if open_ else level
        if raised <= level or not open_:
            break
        level = raised
    target = F.least(F.col("__cap"), F.lit(max(level, 0.0)) * F.col("__weight"))
    return weighed.select("source", "source_size", target.alias("target"))


@table_operator(COLUMNS)
def mix(
    docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", preference: str | None = None,
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0,
) -> DataFrame:
    """Add source_size, target (its source's), copies and taken (copies * size).

    Each document of a source gets the whole copies that its source's target holds of the whole source. The rest
    of the target is a Pareto order sample: a document's inclusion probability p is the rest's share of the
    source (times its ``preference`` over the source's mean one, where such a column is named, and at most 0.999), its rank is the odds of
    a uniform number over the odds of p, and documents are taken by rising rank until their sizes come nearest to
    the rest. Ranks are cut by a histogram of sums: only documents in one of the BINS bins of a source are put in
    order; all others are decided by their bin. Nothing more than sums by source and bin is shuffled.

    Uniform numbers come from key and size, so reruns agree; ties follow the row number. Null sizes count as 0,
    null sources are a source, documents of size 0 take nothing. Repeated rows are documents of their own.
    Columns with the new names are replaced, others stay; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in COLUMNS]
    plain = docs.select(*[quoted(c) for c in kept])
    n = F.coalesce(F.col(quoted(size)).cast("long"), F.lit(0))
    liking = F.greatest(F.coalesce(F.col(quoted(preference)).cast("double"), F.lit(0.0)), F.lit(0.0)) if preference else F.lit(1.0)
    rows = landed(plain.withColumns({
        "__row": F.monotonically_increasing_id(), "__source": F.col(quoted(source)), "__size": n,
        "__u": uniform(F.col(quoted(key)), n, seed=seed), "__like": liking,
    }))
    sized = landed(rows.groupBy(F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"),
        (F.sum(F.col("__size") * F.col("__like")) / F.greatest(F.sum("__size"), F.lit(1))).alias("mean_like"),
    ))
    targets = source_targets(sized.select("source", "source_size"), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = landed(
        targets.join(sized.select(F.col("source").alias("__s"), "mean_like"), F.col("source").eqNullSafe(F.col("__s")))
        .select(
            F.col("source").alias("__src"), F.col("source_size").alias("__total"), F.col("target").alias("__goal"),
            F.floor(ratio).cast("long").alias("__whole"), (ratio - F.floor(ratio)).alias("__p"),
            (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("__rest"), F.col("mean_like").alias("__mean"),
        )
    )
    by_source = F.col("__source").eqNullSafe(F.col("__src"))
    ranked = _ranked(rows.join(plan, by_source))
    drawn = ranked.where(F.col("__rank").isNotNull() & (F.col("__size") > 0))
    sums = drawn.groupBy("__src", "__bin").agg(F.sum("__size").alias("__words"), F.first("__rest").alias("__rest"))
    rising = W.partitionBy("__src").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__words").over(rising), F.lit(0)))
    # the bin in which a source's sum reaches the rest
    edge = landed(
        before.where((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__words") >= F.col("__rest")))
        .select(F.col("__src").alias("__edge_src"), F.col("__bin").alias("__edge_bin"), "__before")
    )
    at_edge = F.col("__src").eqNullSafe(F.col("__edge_src"))
    near = drawn.join(edge, at_edge & (F.col("__bin") == F.col("__edge_bin")))
    order = W.partitionBy("__src").orderBy("__rank", "__row").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = near.withColumn("__sum", F.col("__before") + F.sum("__size").over(order))
    # the last document is taken if the sum with it is as near as without it
    inside = reached.where(2 * F.col("__sum") - F.col("__size") <= 2 * F.col("__rest"))
    cut = inside.groupBy(F.col("__src").alias("__cut_src")).agg(F.max(F.struct("__rank", "__row")).alias("__last"))
    limits = landed(
        plan.join(edge.drop("__before"), at_edge, "left")
        .join(cut, F.col("__src").eqNullSafe(F.col("__cut_src")), "left").drop("__edge_src", "__cut_src")
    )
    # without an edge, all documents that can be drawn together don't reach the rest
    drawn_too = F.when(
        (F.col("__p") > 0) & F.col("__rank").isNotNull() & (
            F.col("__edge_bin").isNull() | (F.col("__bin") < F.col("__edge_bin"))
            | ((F.col("__bin") == F.col("__edge_bin")) & (F.struct("__rank", "__row") <= F.col("__last")))
        ), F.lit(1)
    ).otherwise(F.lit(0))
    copies = F.when(F.col("__size") > 0, F.col("__whole") + drawn_too).otherwise(F.lit(0)).cast("long")
    return _ranked(rows.join(limits, by_source)).select(
        *[quoted(c) for c in kept], F.col("__total").alias("source_size"), F.col("__goal").alias("target"),
        copies.alias("copies"), (copies * F.col("__size")).alias("taken"),
    )


def _ranked(rows: DataFrame) -> DataFrame:
    """Add __rank, odds of the uniform number over the odds of inclusion (null: can't be drawn), and its __bin."""
    chance = F.when(
        F.col("__mean") > 0, F.least(F.lit(0.999), F.col("__p") * F.col("__like") / F.col("__mean"))
    ).otherwise(F.col("__p"))
    odds = F.col("__u") / (1 - F.col("__u"))
    rank = F.when(chance > 0, odds / (chance / (1 - chance)))
    part = F.floor(F.col("__rank") / (1 + F.col("__rank")) * BINS)
    return rows.withColumn("__rank", rank).withColumn("__bin", F.least(part, F.lit(BINS - 1)).cast("int"))
