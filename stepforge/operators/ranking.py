"""Places of rows in an order, and the first of each group, without a task that orders a whole table or a whole group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.functions.stats import seeded_order
from stepforge.session import cut

#: Hex digits of a hash that a histogram looks at in one pass, and rows of one bin that are ordered by a window.
DIGITS, BIN_ROWS = 4, 100_000
_ROW_BITS = 33


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their place (from 0) in an order of columns.

    Rows are dealt to ranges of the whole order (sampled, so equal first values spread too) and sorted there; a place is the
    row's number in its range and the rows of the ranges before, a count for each range. Rows that are equal in all of order are placed by chance."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    dealt = cut(dealt)  # ranges are sampled: what is counted must be what is numbered
    span, own = F.shiftright("_row", _ROW_BITS), F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = dealt.groupBy(span.alias("_span")).agg(F.count("*").alias("_n"))
    before = counts.select("_span", (F.sum("_n").over(Window.orderBy("_span")) - F.col("_n")).alias("_before"))  # a row for each range
    return dealt.withColumn("_span", span).join(F.broadcast(before), "_span").withColumn(name, own + F.col("_before")).drop("_span", "_before", "_row")


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))


def classed(rows: DataFrame, by: list[str], key: str, seed: int, cuts: Callable[[Column], list[Column]], name: str = "class", size: str | None = None) -> DataFrame:
    """rows with a class: 0 for the first cuts(n)[0] of the n rows of their group in hashed order of key, 1 for those up to cuts(n)[1], and so on.

    Counts of hash prefixes, finer and finer, show where each cut falls, so that a filter on the prefix decides for all but the rows of one bin; only these are
    ordered. With size, a column of that name has n. Nulls make a group; rows that repeat a key share their hash and are ordered by chance."""
    hashed = rows.withColumn("_hash", seeded_order(seed, key))
    own = [F.col(c) for c in by]
    counts = hashed.groupBy(*by, F.substring("_hash", 1, DIGITS).alias("_bin")).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    cutting = F.array(*[c.cast("long") for c in cuts(F.col("_total"))])
    asks = totals.select(*by, "_total", F.posexplode(cutting).alias("_class", "_want")).withColumn("_prefix", F.lit(""))
    edges, digits = None, DIGITS
    while True:
        # the bin in which the wanted number is reached; what lies before it is counted off
        upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by, F.substring("_bin", 1, digits - DIGITS)).orderBy("_bin")))
        met = asks.alias("a").join(upto.alias("u"), _same("a", "u", by) & F.col("u._bin").startswith(F.col("a._prefix")) & (F.col("a._want") > F.col("u._upto") - F.col("u._n")) & (F.col("a._want") <= F.col("u._upto")))
        met = met.select(*[F.col(f"a.{c}").alias(c) for c in by], "a._class", "a._total", (F.col("a._want") - F.col("u._upto") + F.col("u._n")).alias("_want"), F.col("u._bin").alias("_prefix"), "u._n")
        if digits + DIGITS > 64 or (counts.agg(F.max("_n")).first()[0] or 0) <= BIN_ROWS:
            edges = met.drop("_n") if edges is None else edges.unionByName(met.drop("_n"))
            break
        met = cut(met)
        open_ = (F.col("_n") > BIN_ROWS) & (F.col("_want") < F.col("_n"))
        edges = met.filter(~open_).drop("_n") if edges is None else edges.unionByName(met.filter(~open_).drop("_n"))
        asks = met.filter(open_).drop("_n")
        # only bins in which a cut falls are counted finer
        inside = hashed.alias("h").join(asks.select(*by, "_prefix").distinct().alias("a"), _same("h", "a", by) & (F.substring("h._hash", 1, digits) == F.col("a._prefix")))
        digits += DIGITS
        counts = inside.groupBy(*[F.col(f"h.{c}").alias(c) for c in by], F.substring("h._hash", 1, digits).alias("_bin")).agg(F.count("*").alias("_n"))
    at = F.array_sort(F.collect_list(F.struct("_class", "_prefix", "_want"))).alias("_cuts")
    # cuts that take nothing, or more than there is, fall into no bin
    every = totals.select(*own, "_total", F.posexplode(cutting).alias("_class", "_asked"))
    edges = edges.select(*by, "_class", "_prefix", "_want")
    full = every.alias("t").join(edges.alias("e"), _same("t", "e", by) & (F.col("t._class") == F.col("e._class")), "left")
    prefix = F.coalesce("e._prefix", F.when(F.col("t._asked") > 0, "~").otherwise(""))
    full = full.select(*[F.col(f"t.{c}").alias(c) for c in by], "t._total", F.col("t._class").alias("_class"), prefix.alias("_prefix"), F.coalesce("e._want", F.lit(0)).alias("_want"))
    cuts_of = full.groupBy(*by, "_total").agg(at)
    both = hashed.alias("h").join(cuts_of.alias("c"), _same("h", "c", by)).select("h.*", "c._cuts", "c._total")
    below = lambda c: F.substring("_hash", 1, F.length(c["_prefix"])) < c["_prefix"]
    on_edge = lambda c: (c["_want"] > 0) & F.col("_hash").startswith(c["_prefix"])
    both = both.withColumn("_edge", F.exists("_cuts", on_edge))
    clear = both.filter(~F.col("_edge")).withColumn(name, F.size(F.filter("_cuts", lambda c: ~below(c))))
    bin_ = F.filter("_cuts", on_edge)[0]["_prefix"]
    edge = both.filter("_edge").withColumn("_bin", bin_)
    place = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_hash", key))
    # an edge row is in the first class whose cut lies behind it, or whose bin is its own and still wants it
    out = lambda c: ~(below(c) | (on_edge(c) & (F.col("_place") <= c["_want"])))
    edge = edge.withColumn("_place", place).withColumn(name, F.size(F.filter("_cuts", out)))
    keep = [*rows.columns, name, *([size] if size else [])]
    return clear.withColumn(size or "_total", F.col("_total")).select(*keep).unionByName(edge.withColumn(size or "_total", F.col("_total")).select(*keep))


def allotted(counts: DataFrame, n: str, total: int) -> DataFrame:
    """counts (a row for each group) with quota: total shared in proportion to n, whole numbers that add up to total; what rounding down leaves goes to the largest remainders, then to larger groups, then in order of the other columns."""
    by = [c for c in counts.columns if c != n]
    of = F.sum(n).over(Window.partitionBy())  # a row for each group
    share = F.expr(f"{total} * cast(`{n}` as decimal(20,0))")
    rest = counts.withColumn("_of", of).withColumn("quota", F.floor(share / F.col("_of")).cast("long")).withColumn("_rest", share - F.col("quota") * F.col("_of"))
    left = F.lit(total) - F.sum("quota").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc(n), *by))
    return rest.withColumn("_left", left).withColumn("_place", place).withColumn("quota", F.col("quota") + (F.col("_place") <= F.col("_left")).cast("long")).select(*counts.columns, "quota")
