"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become words with typed slots: numbers, units after numbers, and names (capitalised words inside a sentence)
turn into one placeholder each, so a question asked again with other numbers or names keeps its template. Windows of
template words are hashed and hash-joined with the benchmark's. Along a run of windows with one offset, the slots
must be filled consistently: one value of the item always by one value of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
COVERAGE = 0.5
CONSISTENT = 0.8
#: Benchmark windows up to this number are broadcast (16 bytes each before overhead); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 500_000

# Units of measure that may follow a number.
UNITS = "mm cm m km mi ft in yd kg g mg lb oz l ml s ms sec min h hr hrs hours minutes seconds days day weeks years usd eur dollars euros cents percent km/h mph w kw v a hz"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(text: Column | str = "text") -> Column:
    """Array of words in lower case without punctuation. Slots start with U+0001 (name), U+0002 (number) or U+0003 (unit), then their value.

    A number with separators (2.50, 1,200, 10:30, 3/4) is one slot, as is a unit with a slash: U+0004 stands for separators within them.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    c = F.translate(c, "\u0004\u0001\u0002\u0003", " ")
    c = F.regexp_replace(c, r"(\p{Ll}[,;:]? )(?=\p{Lu})", "$1\u0001")
    unit = "|".join(u.replace("/", "\\/") for u in sorted(UNITS.split(), key=len, reverse=True))
    numbers = F.regexp_replace(c, r"(?<![\p{L}\p{N}])([0-9][0-9.,:/]*+)", "\u0002$1")
    numbers = F.regexp_replace(numbers, rf"(\u0002[0-9.,:/]++ ?)((?:{unit})(?![\p{{L}}\p{{N}}]))", "$1 \u0003$2")
    numbers = F.regexp_replace(numbers, r"(\u0002[0-9]++|\G[0-9]++)[.,:/]++(?=[0-9])", "$1\u0004")
    numbers = F.regexp_replace(numbers, rf"(\u0003(?:{unit}))/(?=(?:{unit})(?![\p{{L}}\p{{N}}]))", "$1\u0004")
    numbers = F.replace(numbers, F.lit("\u0003km/h"), F.lit("\u0003km\u0004h"))
    c = F.when(c.rlike("[0-9]"), numbers).otherwise(c)
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}\p{M}\x01-\x04]+", -1), lambda w: w != "")


def windows(df: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """Rows ``(key, at, h, slots)``: the hash of each template window, and its slot values in order (null without slots)."""
    d = df.select(key, tokens().alias("w")).withColumn("slotted", F.exists("w", lambda x: x < "\u0004"))
    d = d.withColumn("c", F.when(F.col("slotted"), F.expr("transform(w, x -> if(x < '\\u0004', left(x, 1), x))")).otherwise(F.col("w")))
    each = []
    for n in sizes:
        slots = f"case when slotted then filter(slice(w, i, {n}), x -> x < '\\u0004') end"
        each.append(f"case when size(c) >= {n} then transform(sequence(1, size(c) - {n - 1}), i -> named_struct('at', i, 'h', xxhash64({n}, slice(c, i, {n})), 'slots', {slots})) end")
    none = "cast(array() as array<struct<at:int,h:bigint,slots:array<string>>>)"
    rows = "concat(" + ",".join(f"coalesce({e}, {none})" for e in each) + ")"
    return d.select(key, F.explode(F.expr(rows)).alias("x")).select(key, "x.at", "x.h", "x.slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """Pairs ``(doc_id, item_id, windows, matched, coverage, slots, consistent)`` of documents that hold an item.

    ``coverage``: the share of the item's windows that the document has along consistent runs. Items of fewer words
    than ``window`` are one window; items without words, null texts and null item_ids match nothing. Of several texts under
    one item_id each is searched for; the pair shows the one covered best. Repeated rows count once, a null doc_id is an id.
    ``consistent``: the share of a run's slot values of the item that the document fills with one value each.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    # Each text is an item of its own until the end.
    items = items.withColumn("item_id", F.struct("item_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("which")))
    lengths = items.select(F.least(F.size(tokens()), F.lit(window)).alias("n")).where("n > 0").distinct()
    sizes = sorted(r.n for r in lengths.collect())  # at most ``window`` numbers
    if not sizes:
        sizes = [window]
    short = items.select("item_id", F.least(F.size(tokens()), F.lit(window)).alias("n"))
    parts = [windows(items.join(short.where(F.col("n") == n).select("item_id"), "item_id", "left_semi"), "item_id", [n]) for n in sizes]
    bench = parts[0]
    for p in parts[1:]:
        bench = bench.unionByName(p)
    bench = bench.withColumnsRenamed({"at": "item_at", "slots": "item_slots"})
    totals = bench.groupBy("item_id").agg(F.count("*").alias("windows"))
    count = bench.count()
    side = F.broadcast(bench) if count <= BROADCAST_WINDOWS else bench
    met = windows(docs, "doc_id", sizes).join(side, "h")
    runs = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).agg(
        F.collect_set("item_at").alias("places"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("slots").isNotNull() & F.col("item_slots").isNotNull(), F.arrays_zip("item_slots", "slots"))))).alias("filled"),
    )
    runs = runs.withColumn("values", F.expr("array_distinct(transform(filled, f -> f.item_slots))"))
    runs = runs.withColumn("steady", F.expr("size(filter(values, v -> size(filter(filled, f -> f.item_slots = v)) = 1))"))
    runs = runs.withColumn("share", F.when(F.size("values") > 0, F.col("steady") / F.size("values")).otherwise(F.lit(1.0)))
    pairs = runs.where(F.col("share") >= consistent).groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched"), F.max(F.size("values")).cast("long").alias("slots"), F.min("share").alias("consistent")
    )
    side = F.broadcast(totals) if count <= BROADCAST_WINDOWS else totals
    found = pairs.join(side, "item_id").withColumn("coverage", F.col("matched") / F.col("windows"))
    found = found.where(F.col("coverage") >= coverage).select("doc_id", "item_id.item_id", F.struct("coverage", "matched", "windows", "slots", "consistent").alias("best"))
    return found.groupBy("doc_id", "item_id").agg(F.max("best").alias("b")).select("doc_id", "item_id", "b.windows", "b.matched", "b.coverage", "b.slots", "b.consistent")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; columns stay."""
    found = contaminated(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(*docs.columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """All pairs of ``documents`` and ``benchmark`` items they hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
