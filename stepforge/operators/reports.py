"""Small reports: markdown tables, metric lines, run names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(rows: DataFrame, order: list[str], title: str, most: int = 1000) -> str:
    """A report's table of at most `most` rows; more are an error, since a report is read by people."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{title}: more than {most} rows")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]) + "\n"


def metric_lines(rows: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """line: names and values (six decimals), separated by tabs."""
    return rows.select(F.concat_ws("\t", *names, *[F.format_string("%.6f", F.col(v).cast("double")) for v in values]).alias("line"))


def int_list(text: Column) -> Column:
    """`3,3,3` as an array of positive integers; anything else is an error."""
    parts = F.transform(F.split(text, ","), lambda x: F.try_to_number(F.trim(x), F.lit("9999999999")).cast("int"))
    fine = F.forall(parts, lambda n: F.coalesce(n > 0, F.lit(False)))
    return F.when(fine, parts).otherwise(F.raise_error(F.concat(F.lit("not positive integers: "), text)))


_RUN = re.compile(r"^\d{4}-\d{2}-\d{2}_.+")


def is_run_name(name: str) -> bool:
    return bool(_RUN.match(name))


def next_trial(names: Column, prefix: str) -> Column:
    """One more than the largest number behind the prefix among an array of names; 1 if there is none."""
    numbers = F.transform(names, lambda n: F.regexp_extract(n, "^" + re.escape(prefix) + r"(\d+)$", 1))
    return F.coalesce(F.array_max(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: n.cast("int"))), F.lit(0)) + 1


def script_line(verb: Column, names: Column, ids: Column) -> Column:
    """`[VERB] <a> (1) <b> (2)` of a verb, names and node ids."""
    parts = F.zip_with(names, ids, lambda n, i: F.concat(F.lit("<"), n, F.lit("> ("), i.cast("string"), F.lit(")")))
    return F.concat_ws(" ", F.concat(F.lit("["), F.upper(verb), F.lit("]")), F.array_join(parts, " "))


def positional(pos: Column, dim: int) -> Column:
    """Sinusoidal encoding of a position."""
    pairs = F.sequence(F.lit(0), F.lit(dim - 1))
    angle = lambda i: pos / F.pow(F.lit(10000.0), F.floor(i / 2) * 2 / F.lit(dim))
    return F.transform(pairs, lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))
