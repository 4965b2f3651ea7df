"""Futures contracts, single instruments and tables with two levels of column names."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite

PRICES = ("open", "high", "low", "close")
SHORT = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "oi": "oi"}
# Delivery months by instrument, and those of any other.
MONTHS = {"rb": (1, 5, 10)}
OTHER_MONTHS = (1, 5, 9, 10)


def contract_universe(instrument: str, first_year: int, last_year: int) -> list[str]:
    """Contract codes of an instrument's delivery months, as RB2401; more than trade is no harm, open interest chooses."""
    name = instrument.strip()
    if not name or last_year < first_year:
        raise ValueError("an instrument and years in order are needed")
    return sorted(f"{name.upper()}{y % 100:02d}{m:02d}" for y in range(first_year, last_year + 1) for m in MONTHS.get(name.lower(), OTHER_MONTHS))


def as_date(df: DataFrame, name: str) -> Column:
    """A date from a date, a timestamp, a text, or milliseconds since 1970; null where it can't be read."""
    kind = dict(df.dtypes)[name]
    if kind in ("int", "bigint", "double"):
        return F.timestamp_millis(F.col(name).cast("long")).cast("date")
    return F.col(name).cast("date") if kind != "string" else F.expr(f"try_cast(`{name}` as date)")


def clean_contracts(df: DataFrame, order: str, contract: str = "contract") -> DataFrame:
    """Rows (contract, date, o, h, l, c, v, oi), one for each contract and day: the last by the column ``order``.

    ``df`` has contract, date, open, high, low, close, volume and oi (or hold); ValueError names what is missing. Rows
    without a contract or a readable date go; numbers that can't be read, NaN and infinities are null. Of rows with the same ``order`` the one with the
    larger close stands, so the result does not depend on the order of files. Extra columns are ignored.
    """
    oi = "oi" if "oi" in df.columns else "hold"
    missing = [c for c in (contract, order, "date", *PRICES, "volume", oi) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = lambda c: finite(F.expr(f"try_cast(`{c}` as double)"))
    rows = df.select(F.col(contract).cast("string").alias("contract"), as_date(df, "date").alias("date"), F.col(order).alias("_order"), *[number(c).alias(SHORT[c]) for c in (*PRICES, "volume")], number(oi).alias("oi"))
    rows = rows.where("contract is not null and date is not null")
    last = Window.partitionBy("contract", "date").orderBy(F.desc_nulls_last("_order"), *[F.desc_nulls_last(c) for c in ("c", "v", "oi", "o", "h", "l")])
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_order")


def single_series(df: DataFrame, names: dict[str, str], instrument: str, least_days: int = 200, features: dict[str, str] | None = None) -> DataFrame:
    """The panel (symbol, t, date, o, h, l, c, v, oi, close2, f_...) of one instrument's continuous series.

    ``names`` maps date, open, high, low, close, volume, oi and, if there is one, close2 to columns; ``features`` maps
    names f_... to columns, and is else read off columns so named. Prices, volume and open interest may have no hole:
    ValueError tells how many days have one, the first and the last. Features may. Too few days, and days that are there
    twice, are errors too. The days of one instrument are one task's work.
    """
    needed = ("date", *PRICES, "volume", "oi")
    missing = [k for k in needed if names.get(k) not in df.columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    number = lambda c: finite(F.expr(f"try_cast(`{c}` as double)"))
    found = features if features is not None else {c: c for c in df.columns if c.startswith("f_")}
    close2 = number(names["close2"]) if names.get("close2") in df.columns else F.lit(None).cast("double")
    d = df.select(as_date(df, names["date"]).alias("date"), *[number(names[k]).alias(SHORT[k]) for k in needed[1:]], close2.alias("close2"), *[number(c).alias(k) for k, c in found.items()]).where("date is not null")
    whole = F.lit(True)
    for c in ("o", "h", "l", "c", "v", "oi"):
        whole = whole & F.col(c).isNotNull()
    hole = F.when(~whole, F.col("date"))
    n, days, holes, first, last = d.agg(F.count("*"), F.countDistinct("date"), F.count(hole), F.min(hole), F.max(hole)).first()
    if n != days:
        raise ValueError(f"{n - days} days are there twice")
    if n < least_days:
        raise ValueError(f"{n} days, {least_days} at least are needed")
    if holes:
        raise ValueError(f"{holes} days have holes, the first {first}, the last {last}")
    place = F.row_number().over(Window.orderBy("date")) - 1
    return d.select(F.lit(instrument).alias("symbol"), place.cast("int").alias("t"), "date", "o", "h", "l", "c", "v", "oi", "close2", *found)


def from_two_levels(df: DataFrame, date: str, fields: dict[str, str]) -> DataFrame:
    """Rows (date, symbol, one column for each of ``fields``) of a table whose columns are named like ('close', 'A') or ('A', 'close').

    ``fields`` maps o, h, l, c, v, ... to the field's name in the table. The level that holds all of these names is the
    field; ValueError if none does. A day that is there twice gives the mean. Columns with other names are ignored.
    """
    pairs = []
    for c in df.columns:
        if c.startswith("("):
            try:
                made = ast.literal_eval(c)
            except (ValueError, SyntaxError):
                continue
            if isinstance(made, tuple) and len(made) == 2:
                pairs.append((c, *map(str, made)))
    level = next((k for k in (1, 2) if set(fields.values()) <= {p[k] for p in pairs}), None)
    if level is None:
        raise ValueError("no level of column names holds all fields")
    of = {(p[3 - level], p[level]): p[0] for p in pairs}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`").cast("double")
    symbols = sorted({s for s, _ in of})
    rows = [F.struct(F.lit(s).alias("symbol"), *[(quoted(of[s, f]) if (s, f) in of else F.lit(None).cast("double")).alias(k) for k, f in fields.items()]) for s in symbols]
    long = df.select(as_date(df, date).alias("date"), F.explode(F.array(*rows)).alias("r")).select("date", "r.*").where("date is not null")
    return long.groupBy("date", "symbol").agg(*[F.avg(finite(F.col(k))).alias(k) for k in fields])
