"""First touch: for each entry the first tick that reaches its stop or its target, by a pyramid of minima and maxima over time bins."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import checkpointed

C = F.col


def _hit(low: str = "least", high: str = "most") -> Column:
    return (C(low) <= C("floor")) | (C(high) >= C("ceiling"))


def first_touch(entries: DataFrame, ticks: DataFrame, *, seconds: int = 60, fan: int = 64) -> DataFrame:
    """(entry_id, touched_at, price, reason) for each row of entries (entry_id, symbol, at, side, stop, target): the first tick of ticks
    (symbol, ltt, ltp) after `at` at or beyond the stop or the target; null where none is.

    side is LONG (stop below, target above) or SHORT; a null stop or target is never reached. The price is the tick's, so that a
    jump over a level fills where trading goes on; reason is stop or target, stop if both are one price. Of ticks of one time
    the lowest price counts first. Ticks without price take no part; rows repeated with one entry_id are one entry.

    Bins of `seconds` hold their lowest and highest price, `fan` of them make a bin of the next level, and so on to one bin
    for all. An entry looks at the ticks of its own bin, then at its later siblings on each level, up to one that reaches a
    level of its own, and down again to the first tick. All steps are equality joins on bins, of at most `fan` rows for an
    entry (in the lowest level: a bin's ticks), whatever the time between entry and touch; there is no join of intervals.
    """
    unit = seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t = ticks.where("ltp is not null and ltt is not null").select("symbol", micros("ltt").alias("us"), C("ltp").cast("double").alias("ltp"), "ltt").withColumn("bin", F.floor(C("us") / unit).cast("long"))
    base = checkpointed(t.groupBy("symbol", "bin").agg(F.min("ltp").alias("least"), F.max("ltp").alias("most")))
    first, last = base.agg(F.min("bin"), F.max("bin")).first()
    # Up to bins so large that the table has two of them at most, which share a parent or lie around one border.
    top = 1 + max(0, ceil(log(max(2, (last or 0) - (first or 0) + 2), fan)))
    levels = [base]
    for _ in range(top):
        levels.append(checkpointed(levels[-1].groupBy("symbol", F.floor(C("bin") / fan).cast("long").alias("bin")).agg(F.min("least").alias("least"), F.max("most").alias("most"))))

    long = C("side") == "LONG"
    never_low, never_high = F.lit(float("-inf")), F.lit(float("inf"))
    e = entries.where("entry_id is not null").dropDuplicates(["entry_id"]).select(
        "entry_id", "symbol", micros("at").alias("at"), "side", F.coalesce(F.when(long, C("stop")).otherwise(C("target")).cast("double"), never_low).alias("floor"), F.coalesce(F.when(long, C("target")).otherwise(C("stop")).cast("double"), never_high).alias("ceiling"),
    )

    def in_bin(asked: DataFrame) -> DataFrame:
        """Entries at a bin of the lowest level with its first tick that hits, if one does."""
        found = asked.join(t.select("symbol", "bin", "us", "ltp", "ltt"), ["symbol", "bin"]).where((C("us") > C("at")) & _hit("ltp", "ltp"))
        return found.groupBy("entry_id").agg(F.min(F.struct("us", "ltp", "ltt")).alias("tick"))

    here = e.withColumn("bin", F.floor(C("at") / unit).cast("long"))
    done = checkpointed(in_bin(here))
    left, down = checkpointed(here.join(done, "entry_id", "left_anti")), None
    for k in range(top + 1):
        # Later siblings on this level: bins with the same parent, or all later ones where the table ends.
        parent = lambda x: F.floor(C(x) / fan).cast("long") if k < top else F.lit(0).cast("long")  # noqa: E731, B023
        there = levels[k].select("symbol", parent("bin").alias("parent"), C("bin").alias("to"), "least", "most")
        found = left.withColumn("parent", parent("bin")).join(there, ["symbol", "parent"]).where((C("to") > C("bin")) & _hit()).groupBy("entry_id").agg(F.min("to").alias("to"))
        met = left.join(found, "entry_id", "left")
        met = checkpointed(met)
        here = met.where("to is not null").withColumn("bin", C("to")).withColumn("level", F.lit(k)).drop("to")
        down = here if down is None else down.unionByName(here)
        left = met.where("to is null").drop("to").withColumn("bin", F.floor(C("bin") / fan).cast("long"))
    for k in reversed(range(top)):
        inner = levels[k].select("symbol", F.floor(C("bin") / fan).cast("long").alias("parent"), C("bin").alias("to"), "least", "most")
        above = down.where(C("level") == k + 1)
        nearest = above.withColumnRenamed("bin", "parent").join(inner, ["symbol", "parent"]).where(_hit()).groupBy("entry_id").agg(F.min("to").alias("to"))
        moved = above.drop("bin").join(nearest, "entry_id").withColumnRenamed("to", "bin").withColumn("level", F.lit(k))
        down = checkpointed(down.where(C("level") <= k).unionByName(moved))
    touched = done.unionByName(in_bin(down))
    out = e.join(touched, "entry_id", "left")
    low = C("tick.ltp") <= C("floor")
    reason = F.when(C("tick").isNotNull(), F.when(low == long, "stop").otherwise("target"))
    both = low & (C("tick.ltp") >= C("ceiling"))
    return out.select("entry_id", C("tick.ltt").alias("touched_at"), C("tick.ltp").alias("price"), F.when(both, "stop").otherwise(reason).alias("reason"))
