"""How quality filters interact: what each takes away in every order of application, by a cube over their failure flags.

One row for each document has its failure flags; they are counted by part and flags, which leaves at most 32 rows a
part. A CUBE over the flags and the part follows. Its grouping-set rows in which all selected flags are false are the
survivors of the subset of filters that they select. A filter at a step of an order takes away the survivors of the
filters before it less those of these filters and itself, so each step is a join of two subsets.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table, text_or_empty, tidy_shuffles

FILTERS = "ABCDE"
WORDS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, part, A, B, C, D, E)`` for each row of ``docs(doc_id, text, lang)``: whether each filter rejects the document.

    A: under 100 words. B: under 80 different words in 100. C: over 10 capitals A-Z in 100 code points. D: one of
    ``#$%&*|``. E: the text of a smaller doc_id. Words are what ASCII white space parts. Null text counts as empty,
    a null lang is the part "". A null doc_id is neither smaller nor larger than another; repeated ids are no copies of
    each other. Other columns are ignored.
    """
    text = F.col("text")
    words = F.array_remove(F.split(text, WORDS), "")
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_or_empty().alias("text"))
    base = base.select("doc_id", "part", "text", words.alias("words")).select(
        "doc_id", "part", F.sha2("text", 256).alias("digest"), (F.size("words") < 100).alias("A"), (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("B"),
        (100 * (F.length("text") - F.length(F.translate("text", CAPITALS, ""))) > 10 * F.length("text")).alias("C"), text.rlike(r"[#$%&*|]").alias("D"),
    )
    # Both written: a join right after an aggregation is one that Spark does not split at a hot text.
    flags = materialize(base, "flags")
    first = materialize(flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    out = materialize(flags.join(first, "digest", "left").select("doc_id", "part", *"ABCD", F.expr("coalesce(doc_id > first, false)").alias("E")), "failures")
    discard(flags, first)
    return out


def subset_survivors(failed: DataFrame) -> DataFrame:
    """Rows ``(part, mask, kept, good, toxic)`` of ``failed(part, A..E, good, toxic)``: what no filter of the subset ``mask`` (bit 0 is A) rejects, zeros included."""
    counted = failed.groupBy("part", *FILTERS).agg(F.count("*").alias("kept"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")))
    flags = list(FILTERS)
    cube = counted.cube("part", *flags).agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"no_{f}") for f in flags))
    mask = sum(((1 - F.col(f"no_{f}")) * (1 << i) for i, f in enumerate(flags)), F.lit(0)).cast("int").alias("mask")
    passing = " and ".join(f"not coalesce({f}, false)" for f in flags)
    found = cube.where(f"all_parts = 0 and {passing}").select("part", mask, "kept", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))).alias("mask"))
    return grid.join(found, ["part", "mask"], "left").na.fill(0, ["kept", "good", "toxic"])


def steps() -> list[tuple[str, int, str, int, int]]:
    """(order, step, its filter, subset before, subset after) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            after = before | 1 << FILTERS.index(f)
            out.append(("".join(order), i + 1, f, before, after))
            before = after
    return out


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part of ``docs``, order of the five filters and step; counts of documents, zeros included.

    kept: left after the step. removed: by it. redundant: what its filter rejects too, removed earlier. unique_fails:
    rejected by this filter only. good_lost, toxic_lost: removed here with quality or toxic 1 in ``labels`` (in one of its
    rows, if an id has several). shapley: removed by this filter, summed over all orders. For the filters, nulls and
    repeats see ``failures``; each row of ``docs`` counts. No documents, no rows.
    """
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        failed = failures(docs)
        marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
        marks = materialize(marks.where("good or toxic"), "marks")
        marked = failed.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
        alive = materialize(subset_survivors(marked), "survivors")
        discard(failed, marks)
    whole = (1 << len(FILTERS)) - 1
    plan = spark.createDataFrame(steps(), "filter_order string, step int, filter string, before int, after int")
    own = F.shiftleft(F.lit(1), 0)
    for i in range(1, len(FILTERS)):
        own = F.when(F.col("filter") == FILTERS[i], F.lit(1 << i)).otherwise(own)
    plan = plan.withColumn("own", own).withColumn("others", F.lit(whole) - F.col("own"))
    of = lambda name: alive.select(F.col("part"), F.col("mask").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("kept", "good", "toxic")))
    held = of("before").join(F.broadcast(plan), "before").join(of("after"), ["part", "after"]).join(of("own").drop("good_own", "toxic_own"), ["part", "own"])
    held = held.join(of("others").drop("good_others", "toxic_others"), ["part", "others"])
    total = alive.groupBy("part").agg(F.max(F.expr("if(mask = 0, kept, 0)")).alias("total"), F.max(F.expr(f"if(mask = {whole}, kept, 0)")).alias("last"))
    held = held.join(total, "part").withColumn("removed", F.col("kept_before") - F.col("kept_after"))
    shares = held.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return held.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", F.col("kept_after").alias("kept"), "removed", F.expr("total - kept_own - removed").alias("redundant"), F.expr("kept_others - last").alias("unique_fails"),
        F.expr("good_before - good_after").alias("good_lost"), F.expr("toxic_before - toxic_after").alias("toxic_lost"), "shapley",
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents`` and ``labels``."""
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
with words as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), flags as (
    select doc_id, part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
        100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) as c, regexp_matches(text, '[#$%&*|]') as d,
        coalesce(doc_id > min(doc_id) over (partition by text), false) as e,
        exists (select 1 from labels l where l.doc_id = words.doc_id and l.quality = 1) as good, exists (select 1 from labels l where l.doc_id = words.doc_id and l.toxic = 1) as toxic
    from words
), counted as (
    select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as fails,
        count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
    from flags group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), tried as (
    select part, filter_order, step, substr(filter_order, step, 1) as f, n, good, toxic,
        contains(fails, substr(filter_order, step, 1)) as own, len(regexp_replace(fails, '[^' || left(filter_order, step - 1) || '#]', '', 'g')) > 0 as earlier, len(fails) = 1 as alone
    from counted, orders, (select unnest(range(1, 6)) as step)
), summed as (
    select part, filter_order, step, f, coalesce(sum(n) filter (where not earlier and not own), 0)::bigint as kept, coalesce(sum(n) filter (where not earlier and own), 0)::bigint as removed,
        coalesce(sum(n) filter (where earlier and own), 0)::bigint as redundant, coalesce(sum(n) filter (where own and alone), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where not earlier and own), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where not earlier and own), 0)::bigint as toxic_lost
    from tried group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from summed
"""
