"""Panels from bar tables: reading, layouts, dense grids, checks and a look at unknown files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finite

NEEDED = ("o", "h", "l", "c", "v")
# Names under which fields are found in unknown tables.
SYNONYMS = {
    "date": ("date", "eob", "time", "timestamp", "datetime", "trade_date", "day"),
    "symbol": ("symbol", "code", "ticker", "instrument", "asset"),
    "o": ("open", "o"), "h": ("high", "h"), "l": ("low", "l"), "c": ("close", "c"), "v": ("volume", "vol", "v"),
    "amount": ("amount", "turnover", "money"), "listed": ("listed", "tradable"), "oi": ("oi", "open_interest", "hold"),
}


@dataclass(frozen=True)
class Source:
    """Where bars are and how they lie: layout long, wide or per_symbol; mapping from field to physical column."""

    path: str
    kind: str = "parquet"
    layout: str = "long"
    mapping: dict[str, str] = field(default_factory=dict)
    separator: str = "_"
    symbol_pattern: str = r"([^/]+)\.[A-Za-z]+$"

    @staticmethod
    def from_dict(d: dict) -> Source:
        if extra := set(d) - set(Source.__dataclass_fields__):
            raise ValueError(f"unknown keys: {sorted(extra)}")
        return Source(**d)


def read(spark: SparkSession, s: Source) -> DataFrame:
    if s.kind == "parquet":
        return spark.read.option("mergeSchema", "true").parquet(s.path)
    if s.kind == "csv":
        return spark.read.csv(s.path, header=True, inferSchema=True)
    if s.kind == "json":
        return spark.read.json(s.path)
    raise ValueError(f"unknown kind {s.kind}")


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by mapping and cast: numbers to double with NaN and infinities as NULL, listed to boolean."""
    m = {**{k: k for k in (*NEEDED, "date", "symbol", "amount", "listed") if k in df.columns}, **mapping}
    if missing := [k for k in ("date", "symbol", *NEEDED) if m.get(k) not in df.columns]:
        raise ValueError(f"no column for {missing}")
    cols = [F.col(m["symbol"]).cast("string").alias("symbol"), F.col(m["date"]).cast("date").alias("date")]
    cols += [finite(F.col(m[k]).cast("double")).alias(k) for k in NEEDED]
    cols += [finite(F.col(m["amount"]).cast("double")).alias("amount")] if m.get("amount") in df.columns else []
    cols += [F.col(m["listed"]).cast("boolean").alias("listed")] if m.get("listed") in df.columns else []
    return df.select(*cols)


def from_wide(df: DataFrame, date: str, separator: str = "_") -> DataFrame:
    """Columns ``<symbol><separator><field>`` to long bars; repeated dates are averaged."""
    names = {f: k for k, fs in SYNONYMS.items() for f in fs}
    cols = [c for c in df.columns if c != date and separator in c and c.rsplit(separator, 1)[1].lower() in names]
    long = df.select(F.col(date).alias("date"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("date", cols, "name", "value")
    field_ = F.lower(F.substring_index("name", separator, -1))
    known = F.create_map(*[F.lit(x) for f, k in names.items() for x in (f, k)])
    symbol = F.expr(f"left(name, length(name) - length(substring_index(name, '{separator}', -1)) - {len(separator)})")
    long = long.select(F.col("date").cast("date").alias("date"), symbol.alias("symbol"), known[field_].alias("field"), finite(F.col("value")).alias("value"))
    return long.groupBy("symbol", "date").pivot("field", [*NEEDED, "amount"]).agg(F.avg("value"))


def load(spark: SparkSession, s: Source) -> DataFrame:
    """Long bars of a source. Long and per-symbol layouts must hold one row for a date and symbol."""
    df = read(spark, s)
    if s.layout == "wide":
        return from_wide(df, s.mapping.get("date", "date"), s.separator)
    if s.layout == "per_symbol":
        name = s.mapping.get("symbol", "symbol")
        df = df.withColumn(name, F.regexp_extract(F.input_file_name(), s.symbol_pattern, 1))
    elif s.layout != "long":
        raise ValueError(f"unknown layout {s.layout}")
    out = mapped(df, s.mapping)
    if not out.groupBy("symbol", "date").count().where("count > 1").isEmpty():
        raise ValueError("repeated date and symbol")
    return out


def calendar(bars: DataFrame) -> DataFrame:
    """The union of dates with its row number from 0; a table of dates only, so one task numbers it."""
    return bars.select("date").where("date is not null").distinct().withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def densify(bars: DataFrame) -> DataFrame:
    """One row for every date of the union and every symbol; absent cells are NULL. Both axes are small against the grid they span."""
    grid = bars.select("symbol").distinct().crossJoin(F.broadcast(calendar(bars)))
    out = grid.join(bars, ["symbol", "date"], "left")
    if "amount" not in bars.columns:
        out = out.withColumn("amount", F.lit(None).cast("double"))
    if "listed" not in bars.columns:
        out = out.withColumn("listed", F.lit(True))
    return out.select("symbol", "t", "date", *NEEDED, "amount", "listed")


def tradable(mask_limits: bool = False):
    """Listed, with an amount above zero (where known), and not locked at one price if ``mask_limits``."""
    ok = F.coalesce("listed", F.coalesce(F.col("amount") > 0, F.lit(True))) & F.coalesce(F.col("amount") > 0, F.lit(False))
    return ok & ~F.coalesce(F.col("h") == F.col("l"), F.lit(False)) if mask_limits else ok


def holes(panel: DataFrame) -> DataFrame:
    """By symbol: rows before its first close, missing ones up to its last, and rows after it."""
    live = panel.groupBy("symbol").agg(F.min(F.when(F.col("c").isNotNull(), F.col("t"))).alias("first"), F.max(F.when(F.col("c").isNotNull(), F.col("t"))).alias("last"), F.count("*").alias("n"), F.count("c").alias("valid"))
    inside = F.col("last") - F.col("first") + 1
    return live.select(
        "symbol", F.coalesce("first", "n").cast("long").alias("before_listing"), F.coalesce(inside - F.col("valid"), F.lit(0)).cast("long").alias("inside"),
        F.coalesce(F.col("n") - 1 - F.col("last"), F.lit(0)).cast("long").alias("after_last"),
    )


def validate(panel: DataFrame, min_symbols: int = 20, min_dates: int = 200) -> dict:
    """Counts of a panel and what is wrong with it."""
    r = panel.agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("t").alias("dates"), F.count("c").alias("cells"), F.sum((F.col("v") > 0).cast("long")).alias("traded")).first()
    h = holes(panel).agg(F.sum("before_listing").alias("b"), F.sum("inside").alias("i"), F.sum("after_last").alias("a")).first()
    errors = [f"{n} {k}, at least {m} are needed" for n, k, m in ((r.symbols, "symbols", min_symbols), (r.dates, "dates", min_dates)) if n < m]
    errors += ["no volume above zero"] if not r.traded else []
    return {"symbols": r.symbols, "dates": r.dates, "cells": r.cells, "before_listing": h.b, "inside": h.i, "after_last": h.a, "errors": errors}


def probe(df: DataFrame) -> dict:
    """A mapping guessed from column names, what it lacks, and the extent of a table in one pass."""
    lower = {c.lower(): c for c in df.columns}
    guess = {k: lower[f] for k, fs in SYNONYMS.items() for f in fs[::-1] if f in lower}
    aggs = [F.count("*").alias("rows")]
    aggs += [F.countDistinct(guess["symbol"]).alias("symbols")] if "symbol" in guess else []
    aggs += [F.min(guess["date"]).alias("first"), F.max(guess["date"]).alias("last")] if "date" in guess else []
    return {"mapping": guess, "missing": [k for k in ("date", "symbol", *NEEDED) if k not in guess], "types": dict(df.dtypes), **df.agg(*aggs).first().asDict()}


def regions(panel: DataFrame) -> tuple:
    """Dates that end the first 60 % and 80 % of the calendar."""
    days = panel.select("t", "date").distinct()
    n = days.count()
    got = {r.t: r.date for r in days.where(F.col("t").isin(int(0.6 * n), int(0.8 * n))).collect()}
    return got[int(0.6 * n)], got[int(0.8 * n)]
