"""What each leg of a composite contributes, and which building blocks trials share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.expr import Node, evaluate, leaf, parse
from . import evaluation as E
from .days import PARTS
from .inference import series_moments
from .ledger import deflated_t

JOINS = ("add", "sub")


def legs(node: Node) -> list[tuple[int, ...]]:
    """Paths to the parts that the outermost sums and differences combine, in order; none for fewer than two."""
    found: list[tuple[int, ...]] = []

    def walk(n: Node, path: tuple[int, ...]) -> None:
        if n.op in JOINS:
            for i, a in enumerate(n.args):
                walk(a, (*path, i))
        else:
            found.append(path)

    walk(node, ())
    return found if len(found) > 1 else []


def without(node: Node, path: tuple[int, ...]) -> Node:
    """The tree with the part at ``path`` replaced by the column ``zero``."""
    if not path:
        return leaf("zero")
    i, *rest = path
    return Node(node.op, tuple(without(a, tuple(rest)) if k == i else a for k, a in enumerate(node.args)), node.param)


def part(node: Node, path: tuple[int, ...]) -> Node:
    for i in path:
        node = node.args[i]
    return node


def leg_attribution(panel: DataFrame, composites: dict[str, Node | str], horizon: int, step: int, ok: Column, bar: float) -> DataFrame:
    """Rows (factor, leg, expression, base, value, delta, share, entropy, dominance, incomplete): each leg's part in the deflated t of a composite's IC.

    All composites and all their variants without one leg are evaluated in one staged plan, so what they share is
    computed once. delta is the whole's t less the variant's; share is |delta| over their sum; entropy is that of the
    shares and dominance 1 - entropy / ln(max(legs, 2)), 0 for one known leg. A whole without t has null throughout; a
    variant without t has no delta, and incomplete is true for its composite. Composites of one leg give no rows.
    """
    nodes = {k: parse(v) if isinstance(v, str) else v for k, v in composites.items()}
    names = {k: legs(n) for k, n in nodes.items()}
    plan = {k: n for k, n in nodes.items() if names[k]} | {f"{k}~{i}": without(nodes[k], p) for k, ps in names.items() for i, p in enumerate(ps)}
    spark = panel.sparkSession
    known = spark.createDataFrame([(k, i, f"{k}~{i}", str(part(nodes[k], p))) for k, ps in names.items() for i, p in enumerate(ps)], "factor string, leg int, variant string, expression string")
    valued = evaluate(panel.withColumn("zero", F.lit(0.0)), plan)
    ic = E.day_ic(valued, list(plan), horizon, step, ok)
    t = series_moments(ic).select(F.col("factor").alias("variant"), deflated_t(F.col("sr"), F.col("n"), F.col("g3"), F.col("g4"), bar).alias("t"))
    d = known.join(t.select(F.col("variant").alias("factor"), F.col("t").alias("base")), "factor", "left").join(t.withColumnRenamed("t", "value"), "variant", "left")
    d = d.withColumn("delta", F.col("base") - F.col("value"))
    whole = d.groupBy("factor").agg(F.sum(F.abs("delta")).alias("total"), F.count("delta").alias("k"), F.count("*").alias("of"))
    d = d.join(whole, "factor").withColumn("share", F.when(F.col("delta").isNotNull(), F.abs("delta") / F.greatest(F.col("total"), F.lit(1e-12))))
    spread = d.groupBy("factor").agg(F.sum(F.when(F.col("share") > 0, -F.col("share") * F.ln("share")).otherwise(0.0)).alias("h"))
    d = d.join(spread, "factor").withColumn("entropy", F.when(F.col("k") > 0, F.col("h")))
    dominance = F.when(F.col("k") > 1, 1 - F.col("h") / F.ln(F.greatest(F.col("k"), F.lit(2)).cast("double"))).when(F.col("k") == 1, 0.0)
    return d.select("factor", "leg", "expression", "base", "value", "delta", "share", "entropy", dominance.alias("dominance"), (F.col("k") < F.col("of")).alias("incomplete"))


def frequent_blocks(trials: DataFrame, blocks: DataFrame, support: int = 12, size: int = 3) -> DataFrame:
    """Rows (items, size, n, whole) of sets of building blocks: those of 2 to ``size`` blocks that ``support`` trials share, and whole sets that as many trials consist of.

    ``trials(source_hash)`` and ``blocks(source_hash, block)``; a source counts once, however often it was tried. Level
    by level: a set can only be frequent if all its parts are, so a trial offers only sets made of frequent smaller ones.
    items are in order. A source's blocks are a small set; its sets are made within its row.
    """
    held = trials.select("source_hash").distinct().join(blocks.where("block is not null").distinct(), "source_hash").groupBy("source_hash").agg(F.array_sort(F.collect_set("block")).alias("all"))
    whole = held.groupBy(F.col("all").alias("items")).agg(F.count("*").alias("n")).where(F.col("n") >= support).select("items", F.size("items").alias("size"), "n", F.lit(True).alias("whole"))
    items = held.select("source_hash", F.explode("all").alias("block"))
    frequent = items.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("block")
    rows = items.join(frequent, "block").select("source_hash", F.array("block").alias("items"), F.col("block").alias("last"))
    single, level, out = rows.select("source_hash", "last"), rows, whole
    for k in range(2, size + 1):
        longer = level.join(single.withColumnRenamed("last", "next"), "source_hash").where("next > last").select("source_hash", F.concat("items", F.array("next")).alias("items"), F.col("next").alias("last"))
        if k > 2:  # every part without one item must have been kept at the level before
            parts = longer.select("items").distinct().withColumn("part", F.explode(F.expr(f"transform(sequence(0, {k - 1}), i -> filter(items, (v, j) -> j <> i))")))
            good = parts.join(kept.select(F.col("items").alias("part")), "part").groupBy("items").count().where(F.col("count") == k).select("items")  # noqa: F821
            longer = longer.join(good, "items").select("source_hash", "items", "last")
        kept = longer.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)
        out = out.unionByName(kept.select("items", F.lit(k).alias("size"), "n", F.lit(False).alias("whole")))
        level = longer.join(kept.select("items"), "items").select("source_hash", "items", "last")
    return out


def block_names(node: Node) -> list[str]:
    """Operators with their parameters and columns of a tree, level by level from the root."""
    out, level = [], [node]
    while level:
        out += [n.op if n.param is None else f"{n.op}[{n.param}]" for n in level]
        level = [a for n in level for a in n.args]
    return out


def structure_links(trials: DataFrame, least: float = 0.7, bound: int = 20_000, bytewise: bool = False, tile: int = 1_000) -> DataFrame:
    """Rows (a, b, similarity) for a < b of ``trials(key, tokens array<string>)`` with 0.6 * Jaccard + 0.4 * edit similarity >= least.

    Exact, and no pair is lost: as the edit part gives 0.4 at most, the sets must reach j = (least - 0.4) / 0.6, so two
    sets share one of the first |set| - ceil(j * |set|) + 1 tokens, taken from the rarest on; only such pairs are
    compared, at the rarest token that both hold and nowhere else. Equal lists count as one: different lists are compared
    once, and the keys that have them are paired at the end, so that nothing but the links grows with the copies of a
    list. Keys of a list are dealt to tiles of about ``tile``, each paired in a group of its own, over PARTS partitions
    or more: few keys make many links, so the partitions' number cannot follow from the keys' bytes.
    Tokens become single characters, so Spark's own edit distance runs over them: ``bound`` different tokens
    at most (operators, parameters and columns are a grid). A null or empty array is linked to nothing, ``least`` must exceed 0.4.
    The distance counts tokens, or with ``bytewise`` the bytes of their characters in UTF-8, dealt in order of token, as
    DuckDB's levenshtein does: then a token more or less counts three, one replaced by one of the same 64 counts one.
    """
    j = (least - 0.4) / 0.6
    if j <= 0:
        raise ValueError("a similarity above 0.4 is needed")
    d = trials.where("size(tokens) > 0").select("key", "tokens")
    counts = d.select("tokens").distinct().select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").count()
    ranked = [r.token for r in counts.orderBy("count", "token").limit(bound + 1).collect()]  # bounded by the check below
    if len(ranked) > bound:
        raise ValueError(f"{bound} different tokens at most")
    if not ranked:
        return d.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("similarity"))
    coding = lambda tokens, code: F.create_map(*[F.lit(x) for i, t in enumerate(tokens) for x in (t, code(i))])
    ranks = coding(ranked, lambda i: i)
    letters = coding(sorted(ranked) if bytewise else ranked, lambda i: chr(0x4E00 + i) if i < 0x5200 else chr(0x20000 + i))
    coded = d.select("key", F.array_join(F.transform("tokens", lambda t: letters[t]), "").alias("text"), F.array_sort(F.array_distinct(F.transform("tokens", lambda t: ranks[t]))).alias("set"))
    kinds = coded.groupBy("text", "set").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    first = F.expr(f"slice(set, 1, cast(size(set) - ceil({j!r}D * size(set) - 1e-9) + 1 as int))")
    filed = kinds.select("text", "set", "tiles", F.explode(first).alias("token"))
    x, y = (filed.select(F.col("text").alias(f"t{k}"), F.col("set").alias(f"s{k}"), F.col("tiles").alias(f"n{k}"), "token") for k in "ab")
    both = F.array_intersect("sa", "sb")  # in order: what is first in both is among the first of each
    jaccard = F.size(both) / F.size(F.array_union("sa", "sb"))
    spelt = [F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") if bytewise else F.col(c) for c in ("ta", "tb")]  # a letter for each byte
    edit = 1 - F.levenshtein(*spelt) / F.greatest(F.length("ta"), F.length("tb"))
    met = x.join(y, "token").where("ta < tb").where(F.get(both, F.lit(0)) == F.col("token")).where(jaccard >= j - 1e-9)
    near = met.withColumn("similarity", 0.6 * jaccard + 0.4 * edit).where(F.col("similarity") >= least - 1e-12).select("ta", "tb", "nb", "similarity")
    alike = kinds.where(F.lit(least <= 1 + 1e-12)).select(F.col("text").alias("ta"), F.col("text").alias("tb"), F.col("tiles").alias("nb"), F.lit(1.0).alias("similarity"))
    held = coded.select("key", "text").distinct()
    left = held.select(F.col("key").alias("x"), F.col("text").alias("ta")).join(near.unionByName(alike), "ta").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    sized = held.join(kinds.select("text", "tiles"), "text")
    right = sized.select(F.col("key").alias("y"), F.col("text").alias("tb"), F.pmod(F.xxhash64("key"), F.col("tiles")).alias("tile"))
    pairs = left.repartition(PARTS, "tb", "tile").join(right, ["tb", "tile"]).where("x < y or (ta <> tb and x > y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
