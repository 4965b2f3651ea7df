"""Contract cleaning, single instruments and two-level columns: repeats, holes, unreadable values, empty tables."""

import pytest

from tessera.sources import contracts as C

RAW = "contract string, date string, seq int, open string, high double, low double, close double, volume double, hold double, o int"


def test_last_row_of_a_contract_and_day_stands(spark):
    rows = [
        ("a", "2024-01-02", 1, "1.5", 2.0, 1.0, 1.7, 10.0, 5.0, 0), ("a", "2024-01-02", 2, "x", 2.0, 1.0, float("nan"), 11.0, 6.0, 0), ("a", "no date", 3, "1", 2.0, 1.0, 1.7, 10.0, 5.0, 0),
        (None, "2024-01-02", 1, "1", 2.0, 1.0, 1.7, 10.0, 5.0, 0), ("a", None, 1, "1", 2.0, 1.0, 1.7, 10.0, 5.0, 0), ("b", "2024-01-02", None, "1", None, 1.0, 1.7, 10.0, 5.0, 0), ("b", "2024-01-02", None, "1", None, 1.0, 1.9, 10.0, 5.0, 0),
    ]
    df = spark.createDataFrame(rows, RAW)
    got = {r.contract: r for r in C.clean_contracts(df, "seq").collect()}
    assert set(got) == {"a", "b"} and (got["a"].o, got["a"].c, got["a"].v, got["a"].oi) == (None, None, 11.0, 6.0) and (got["b"].c, got["b"].h) == (1.9, None)
    assert C.clean_contracts(df.limit(0), "seq").count() == 0
    with pytest.raises(ValueError, match="hold"):
        C.clean_contracts(df.drop("hold"), "seq")
    ms = spark.createDataFrame([("a", 1704153600000, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "contract string, date long, seq int, open double, high double, low double, close double, volume double, oi double")
    assert str(C.clean_contracts(ms, "seq").first().date) == "2024-01-02"


def test_universe():
    assert C.contract_universe(" rb ", 2024, 2025) == ["RB2401", "RB2405", "RB2410", "RB2501", "RB2505", "RB2510"]
    assert len(C.contract_universe("zz", 2024, 2024)) == 4
    with pytest.raises(ValueError):
        C.contract_universe("rb", 2025, 2024)


def test_single_series(spark):
    names = {"date": "d", "open": "x", "high": "x", "low": "x", "close": "x", "volume": "x", "oi": "x", "close2": "y"}
    df = spark.createDataFrame([(f"2024-01-{i + 1:02d}", 1.0 + i, None, None if i < 3 else 0.5, "z") for i in range(28)], "d string, x double, y double, f_k double, symbol string")
    got = C.single_series(df, names, "rb", 28).orderBy("t").collect()
    assert [r.t for r in got] == list(range(28)) and got[0].f_k is None and got[5].f_k == 0.5 and got[3].c == 4.0 and got[0].symbol == "rb"
    for bad, words in ((df.unionByName(df.limit(1)), "twice"), (df.limit(5), "28 at least"), (df.withColumn("x", df.y), "28 days have holes, the first 2024-01-01, the last 2024-01-28")):
        with pytest.raises(ValueError, match=words):
            C.single_series(bad, names, "rb", 28)
    with pytest.raises(ValueError, match="oi"):
        C.single_series(df, {k: v for k, v in names.items() if k != "oi"}, "rb", 28)


def test_two_levels_of_names(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, 2.0, 9.0, 5), ("2024-01-01", 3.0, None, 9.0, 5), ("2024-01-02", None, float("inf"), 9.0, 5)], "d string, `('close', 'A')` double, `('close', 'B')` double, `('open', 'A')` double, other int")
    want = {("2024-01-01", "A"): (2.0, 9.0), ("2024-01-01", "B"): (2.0, None), ("2024-01-02", "A"): (None, 9.0), ("2024-01-02", "B"): (None, None)}
    fields = {"c": "close", "o": "open"}
    assert {(str(r.date), r.symbol): (r.c, r.o) for r in C.from_two_levels(df, "d", fields).collect()} == want
    turned = df.toDF("d", "('A', 'close')", "('B', 'close')", "('A', 'open')", "other")
    assert {(str(r.date), r.symbol): (r.c, r.o) for r in C.from_two_levels(turned, "d", fields).collect()} == want
    with pytest.raises(ValueError):
        C.from_two_levels(df, "d", {"v": "volume"})
