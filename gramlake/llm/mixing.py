"""Mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.runtime import free, plan_bytes, stage

#: Terms of the inverted distribution of one draw: its rate is at most MAX_RATE, where the tail beyond is under 1e-15.
#: Higher rates are sums of independent draws.
MAX_RATE, TERMS = 8.0, 48
#: Bytes of input that a range of the global order takes, as files hold it.
PART_BYTES = 128 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ':': 52 bits, the same in any engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_count(u: Column, rate: Column) -> Column:
    """The Poisson quantile of u: how many terms of the cumulative distribution are at most u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["n"] + (acc["cdf"] <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])


def repeats(rate: Column, *parts: Column) -> Column:
    """A Poisson count of any rate: up to MAX_RATE one draw at the parts' uniform number, above it a sum of draws of equal
    rates, each at most MAX_RATE, whose numbers are hashed from the parts and the draw's number."""
    draws = F.ceil(rate / MAX_RATE).cast("int")
    more = lambda acc, k: acc + poisson_count(uniform(*parts, F.lit("draw"), k), rate / draws)
    return F.when(rate <= MAX_RATE, poisson_count(uniform(*parts), rate)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(draws, F.lit(1))), F.lit(0), more))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(src, rate): mean repetitions that bring each source's rows to its target share of scale * rows.

    Without weights the targets are the shares raised to temperature. Sources without a weight get none. A rate
    has no upper end.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        want = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        want = F.lit(0.0)
        for name, w in weights.items():
            want = F.when(F.col("src") == name, F.lit(float(w))).otherwise(want)
    sizes = sizes.withColumn("want", want)
    # sums of shares: one row, however many sources; the order of the sum does not matter after rounding
    total = sizes.agg(F.sum("n").alias("rows"), F.sum("want").alias("all")).first()
    rows, every = float(total["rows"] or 0), float(total["all"] or 0)
    if not math.isfinite(every) or every <= 0:
        return sizes.select("src", F.lit(0.0).alias("rate"))
    return sizes.select("src", F.round(F.lit(scale * rows / every) * F.col("want") / F.col("n"), 9).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, scale: float = 1.0, seed: int = 11, shuffle: bool = True) -> DataFrame:
    """Rows of docs, each repeated by a Poisson count with its source's rate, in a global random order.

    The count inverts the Poisson distribution at uniform numbers hashed from (doc_id, text, seed), so that a lost task
    repeats itself exactly and copies of a doc_id with other texts draw on their own. Appended: mix_rate (double), mix_copy
    (int, from 0), mix_key (double, the place in the global order). Columns of those three names in docs are replaced; all
    others go through. The order is a partitioning into equal ranges of mix_key, so no source or document gathers in a task.

    A null source is the source ''. Null doc_ids and texts hash as ''. Identical rows draw the same count and the same
    mix_keys; among equal keys the order is not fixed, and cannot be told from the rows. An empty table
    gives an empty result.
    """
    plain = docs.drop("mix_rate", "mix_copy", "mix_key")
    src, n = free(plain, "mix_src", "mix_n")
    # written first, so that the plan knows its size: texts are not shuffled to meet a few sources
    table = stage(rates(docs, weights, temperature, scale).withColumnsRenamed({"src": src, "rate": "mix_rate"}), "rates")
    rows = plain.withColumn(src, F.coalesce("source", F.lit(""))).join(table, src).drop(src)
    digest = F.md5(F.coalesce("text", F.lit("")))
    draw = repeats(F.col("mix_rate"), F.col("doc_id"), digest, F.lit(seed))
    rows = rows.withColumn(n, draw).where(F.col(n) > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    rows = rows.withColumn("mix_key", uniform(F.col("doc_id"), digest, F.lit(seed), F.lit("order"), F.col("mix_copy")))
    if not shuffle:
        return rows
    # keys are uniform in [0, 1): equal ranges are even without a sampling pass over the texts; their number follows the input
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(max(scale, 1.0) * (plan_bytes(docs) or 0) / PART_BYTES))
    return rows.repartitionById(parts, F.floor(F.col("mix_key") * parts).cast("int")).sortWithinPartitions("mix_key")


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of mixed(docs) with the columns of docs alone: those named like a column of its own keep their values."""
    own = {c: new for c, new in zip(docs.columns, free(docs, *[f"own_{k}" for k in range(len(docs.columns))]), strict=True) if c.lower() in ("mix_rate", "mix_copy", "mix_key")}
    return mixed(docs.withColumnsRenamed(own)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
