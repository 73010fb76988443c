"""Support and resistance: pivots, Fibonacci levels, swings, round numbers and volume profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keep import checkpointed
from ..operators.resample import resample
from ..operators.windows import lag, latest
from ..schema import ratio
from .swings import with_swings

C = F.col
# The levels' parts of a swing.
RETRACEMENTS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
EXTENSIONS = (0.618, 1.0, 1.272, 1.414, 1.618, 2.0, 2.618)
FANS = (0.382, 0.5, 0.618)


def pivots(method: str = "classic", o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> Column:
    """Prices by name (P, R1, S1, ...) as a map; an unknown method gives an empty one."""
    op, hi, lw, cl = C(o), C(h), C(lo), C(c)
    rng = hi - lw
    made: dict[str, Column] = {}
    if method == "classic":
        p = (hi + lw + cl) / 3
        made = {"P": p, "R1": 2 * p - lw, "S1": 2 * p - hi, "R2": p + rng, "S2": p - rng, "R3": p + 2 * rng, "S3": p - 2 * rng}
    elif method == "woodie":
        p = (hi + lw + 2 * cl) / 4
        made = {"P": p, "R1": 2 * p - lw, "S1": 2 * p - hi, "R2": p + rng, "S2": p - rng}
    elif method == "camarilla":
        for k, part in enumerate((12, 6, 4, 2), 1):
            made |= {f"R{k}": cl + rng * 1.1 / part, f"S{k}": cl - rng * 1.1 / part}
    elif method == "fibonacci":
        p = (hi + lw + cl) / 3
        made = {"P": p} | {f"{s}{k}": p + (x if s == "R" else -x) * rng for s in "RS" for k, x in enumerate((0.382, 0.618, 1.0), 1)}
    elif method == "demark":
        x = F.when(cl < op, hi + 2 * lw + cl).when(cl > op, 2 * hi + lw + cl).otherwise(hi + lw + 2 * cl)
        made = {"P": x / 4, "R1": x / 2 - lw, "S1": x / 2 - hi}
    if not made:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*(y for name, price in made.items() for y in (F.lit(name), price)))


def level_type(name: Column) -> Column:
    return F.when(name == "P", "pivot").when(name.startswith("R"), "resistance").otherwise("support")


def pivot_levels(bars: DataFrame, method: str = "classic") -> DataFrame:
    """(symbol, ts, name, price): each bar's pivots from the bar before."""
    cols = ("open", "high", "low", "close")
    d = bars.select("symbol", "ts", *(lag(x).alias(f"_{x}") for x in cols)).where("_close is not null")
    return d.select("symbol", "ts", F.explode(pivots(method, "_open", "_high", "_low", "_close")).alias("name", "price"))


def period_pivots(bars: DataFrame, every: str, method: str = "classic") -> DataFrame:
    """(symbol, name, price) from the last week or month ('1w', '1mo') but one."""
    down = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    d = resample(bars, every).withColumn("_k", F.row_number().over(down)).where("_k = 2")
    return d.select("symbol", F.explode(pivots(method)).alias("name", "price"))


def fibonacci(high: Column, low: Column, up: Column, parts: tuple[float, ...] = RETRACEMENTS) -> Column:
    """Prices that lie back from the end of a swing by parts of it, as structs of part and price."""
    size = high - low
    return F.array(*(F.struct(F.lit(x).alias("part"), F.when(up, high - size * x).otherwise(low + size * x).alias("price")) for x in parts))


def major_swing(bars: DataFrame, n: int = 50) -> DataFrame:
    """(symbol, swing_high, swing_low, up) of the last n bars; up: the low came first. The first of equal extremes counts."""
    d = latest(bars, n).groupBy("symbol").agg(
        F.max("high").alias("swing_high"), F.min("low").alias("swing_low"),
        F.max_by("ts", F.struct(C("high"), -F.unix_micros(C("ts").cast("timestamp")))).alias("_hi"), F.min_by("ts", F.struct("low", "ts")).alias("_lo"),
    )
    return d.select("symbol", "swing_high", "swing_low", (C("_lo") < C("_hi")).alias("up"))


def auto_fibonacci(bars: DataFrame, n: int = 50, parts: tuple[float, ...] = RETRACEMENTS) -> DataFrame:
    d = major_swing(bars, n)
    return d.select("symbol", F.explode(fibonacci(C("swing_high"), C("swing_low"), C("up"), parts)).alias("x")).select("symbol", "x.part", "x.price")


def fibonacci_levels(bars: DataFrame, parts: tuple[float, ...], n: int = 50) -> DataFrame:
    """(symbol, part, price, level_type) of the swing of the last n bars, for extensions (EXTENSIONS) and fans (FANS); symbols with fewer bars have none."""
    whole = bars.groupBy("symbol").agg(F.count("*").alias("_n")).where(C("_n") >= n).select("symbol")
    d = major_swing(bars.join(whole, "symbol", "left_semi"), n)
    d = d.select("symbol", "up", F.explode(fibonacci(C("swing_high"), C("swing_low"), C("up"), parts)).alias("x"))
    return d.select("symbol", "x.part", "x.price", F.when(C("up"), "support").otherwise("resistance").alias("level_type"))


def swing_levels(bars: DataFrame, w: int = 5, near: float = 0.005) -> DataFrame:
    """(symbol, price, level_type, touches, strength): distinct swing prices, scored by how many closes come near.

    Closes are counted by price first and levels look up the price bins around them: an equality join on bins as wide as
    the largest distance, with the exact distance checked after it.
    """
    d = with_swings(bars, w)
    highs = d.where("swing_high is not null").select("symbol", C("swing_high").alias("price"), F.lit("resistance").alias("level_type"))
    lows = d.where("swing_low is not null").select("symbol", C("swing_low").alias("price"), F.lit("support").alias("level_type"))
    levels = highs.unionByName(lows).distinct()
    # On a logarithmic scale the distance is the same everywhere: a close within near of the price is at most a bin away.
    width = near * 1.01 / (1 - near)
    place = lambda x: F.floor(F.ln(x) / width)
    closes = bars.where("close > 0").groupBy("symbol", "close").count().withColumn("_bin", place(C("close")))
    wide = levels.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: place(C("price")) + k)))
    hits = wide.join(closes, ["symbol", "_bin"]).where(F.abs(C("close") - C("price")) <= C("price") * near)
    touched = hits.groupBy("symbol", "price", "level_type").agg(F.sum("count").alias("touches"))
    out = levels.join(touched, ["symbol", "price", "level_type"], "left").withColumn("touches", F.coalesce("touches", F.lit(0)))
    return out.withColumn("strength", F.least(C("touches") / 10, F.lit(1.0)))


def cluster_levels(levels: DataFrame, part: float = 0.005) -> DataFrame:
    """(symbol, price, size): means of neighbouring prices of levels (symbol, price): a price more than `part` above its cluster's first
    opens a new one.

    The first price above 1 + part times another is that one's successor, found by a window over prices and bounds in one order.
    The lowest price opens a cluster, and so does each price that successors lead to from there: jumps double in each turn, so
    that a symbol's chain of any length takes few turns and no array of its levels. Prices are positive; null ones are left out.
    """
    price = levels.where("price is not null").groupBy("symbol", "price").agg(F.count("*").alias("count"))
    # Bounds stand behind prices equal to them, as a successor is above the bound.
    points = price.select("symbol", C("price").alias("at"), F.lit(0).alias("kind"), "price").unionByName(price.select("symbol", (C("price") * (1 + part)).alias("at"), F.lit(1).alias("kind"), "price"))
    after = Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    nxt = points.withColumn("next", F.first(F.when(C("kind") == 0, C("price")), ignorenulls=True).over(after)).where("kind = 1").select("symbol", "price", "next")
    first = price.groupBy("symbol").agg(F.min("price").alias("price"))
    jumps, starts, known = checkpointed(nxt.where("next is not null")), first, 0
    while True:
        reached = starts.join(jumps, ["symbol", "price"]).select("symbol", C("next").alias("price"))
        starts = checkpointed(starts.unionByName(reached).distinct())
        n = starts.count()
        if n == known:
            break
        known = n
        on = jumps.select("symbol", C("price").alias("next"), C("next").alias("_far"))
        jumps = checkpointed(jumps.join(on, ["symbol", "next"]).select("symbol", "price", C("_far").alias("next")))
    upto = Window.partitionBy("symbol").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    opened = price.join(starts.withColumn("opens", C("price")), ["symbol", "price"], "left").withColumn("opens", F.last("opens", ignorenulls=True).over(upto))
    return opened.groupBy("symbol", "opens").agg((F.sum(C("price") * C("count")) / F.sum("count")).alias("price"), F.sum("count").alias("size")).drop("opens")


def round_numbers(bars: DataFrame, steps: int = 5) -> DataFrame:
    """(symbol, price, level_type) around the last close, at multiples of its size's step."""
    d = latest(bars).where("close > 0")
    step = F.pow(F.lit(10.0), F.floor(F.log10("close"))) / 10
    d = d.withColumn("_step", F.greatest(step, F.lit(0.01))).withColumn("_mid", F.bround(C("close") / C("_step"), 0) * C("_step"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn("price", C("_mid") + C("k") * C("_step")).where("price > 0")
    return d.select("symbol", "price", F.when(C("price") > C("close"), "resistance").otherwise("support").alias("level_type"))


def recent_high_low(bars: DataFrame, n: int = 20) -> DataFrame:
    return latest(bars, n).groupBy("symbol").agg(F.max("high").alias("recent_high"), F.min("low").alias("recent_low"))


def volume_profile(bars: DataFrame, bins: int = 50, prominence: float = 1.5) -> DataFrame:
    """(symbol, bin, price, volume, is_node): volume by equal bins of the close, closed to the right; nodes stand out over the mean of all bins."""
    span = bars.groupBy("symbol").agg(F.min("close").alias("_low"), F.max("close").alias("_high"), F.sum("volume").alias("_all"))
    d = bars.join(span, "symbol").withColumn("_w", (C("_high") - C("_low")) / bins)
    place = F.greatest(F.coalesce(F.ceil(ratio(C("close") - C("_low"), C("_w"))), F.lit(1)), F.lit(1))
    d = d.withColumn("bin", F.least(place, F.lit(bins)).cast("int")).groupBy("symbol", "bin", "_low", "_w", "_all").agg(F.sum("volume").alias("volume"))
    return d.select("symbol", "bin", (C("_low") + (C("bin") - 0.5) * C("_w")).alias("price"), "volume", (C("volume") > prominence * C("_all") / bins).alias("is_node"))


def all_levels(bars: DataFrame, w: int = 5) -> DataFrame:
    """(symbol, price, strength, level_type, source): pivots of the bar before the last, swings and retracements of the whole range."""
    last = latest(bars).select("symbol", C("ts").alias("_ts"))
    p = pivot_levels(bars).join(last, "symbol").where("ts = _ts").select("symbol", "price", F.lit(0.0).alias("strength"), level_type(C("name")).alias("level_type"), F.lit("classic").alias("source"))
    s = swing_levels(bars, w).select("symbol", "price", "strength", "level_type", F.lit("swing").alias("source"))
    f = auto_fibonacci(bars, 1 << 30).select("symbol", "price", F.lit(0.0).alias("strength"), F.lit("fibonacci").alias("level_type"), F.lit("fibonacci").alias("source"))
    return p.unionByName(s).unionByName(f)


def nearest_levels(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """(symbol, close, support, resistance): the nearest levels below and above the last close."""
    d = latest(bars).select("symbol", "close").join(levels.select("symbol", "price"), "symbol", "left")
    return d.groupBy("symbol", "close").agg(F.max(F.when(C("price") < C("close"), C("price"))).alias("support"), F.min(F.when(C("price") > C("close"), C("price"))).alias("resistance"))


def near_price(levels: DataFrame, price: str, part: float = 0.01) -> DataFrame:
    return levels.where(ratio(F.abs(C("price") - C(price)), C(price)) <= part)


def by_strength(levels: DataFrame) -> DataFrame:
    return levels.orderBy(F.desc("strength"), "symbol", "price", "level_type", "source")
