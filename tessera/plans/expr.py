"""Expressions over a panel, and how they become staged window plans.

``Node`` trees are hash-consed: equal subtrees of all factors of one call become one column. Elementwise operators
are folded into the column that uses them; each window operator gets a column of its own, so windows over one layout
share one exchange and sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..operators import rolling
from ..operators.panel_ops import OPS, TAKES

# The grids of windows, delays and hump sizes.
WINDOWS = (3, 5, 10, 20, 60, 120, 250)
DELAYS = (1, 2, 3, 5, 10, 20)
HUMPS = (0.01, 0.05, 0.10)
SAME_SPACE = frozenset("add sub minv maxv signed_diff gt lt where".split())


class PlanError(ValueError):
    """An expression that has no valid plan."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple[Node, ...] = ()
    param: float | int | None = None

    def __str__(self) -> str:
        if not self.args:
            return self.op
        return f"{self.op}{'' if self.param is None else f'[{self.param}]'}({', '.join(map(str, self.args))})"


def leaf(name: str) -> Node:
    return Node(name)


def parse(text: str) -> Node:
    """Read ``op[param](arg, ...)``."""
    tokens = re.findall(r"[A-Za-z_]\w*|[\[\](),]|-?[0-9.]+(?:e-?[0-9]+)?", text)
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (want and tokens[at] != want):
            raise PlanError(f"cannot read {text!r}")
        at += 1
        return tokens[at - 1]

    def node() -> Node:
        name, param, args = take(), None, []
        if at < len(tokens) and tokens[at] == "[":
            take("[")
            raw = take()
            param = float(raw) if "." in raw or "e" in raw else int(raw)
            take("]")
        if at < len(tokens) and tokens[at] == "(":
            take("(")
            args.append(node())
            while tokens[at : at + 1] == [","]:
                take(",")
                args.append(node())
            take(")")
        return Node(name, tuple(args), param)

    got = node()
    if at != len(tokens):
        raise PlanError(f"cannot read {text!r}")
    return got


def space(node: Node) -> str:
    """raw, norm or bool: what kind of values an expression has."""
    if not node.args:
        return "raw"
    if node.op in ("gt", "lt"):
        return "bool"
    if OPS[node.op].kind == "cs" or node.op in ("ts_rank", "ts_zscore", "ts_corr", "ts_rank_corr", "ts_range_pos", "signx", "signed_diff", "sfdiff", "sigmoid", "tanhx", "softsign"):
        return "norm"
    if node.op == "where":
        return space(node.args[1])
    return "norm" if all(space(a) == "norm" for a in node.args) else "raw"


def check(node: Node, columns: set[str], single: bool = False, typed: bool = False) -> None:
    """Raise PlanError for unknown names, wrong arity, windows too short for their valid rows, and broken space rules."""
    if not node.args:
        if node.op not in columns:
            raise PlanError(f"no column {node.op}")
        return
    o = OPS.get(node.op)
    if o is None or len(node.args) != o.arity or (node.param is None) != (o.param is None):
        raise PlanError(f"{node}: unknown operator, or wrong inputs")
    if o.kind == "cs" and single:
        raise PlanError(f"{node.op} needs a cross section")
    if o.param in ("window", "delay") and (int(node.param) != node.param or node.param < 1):
        raise PlanError(f"{node}: a whole number of rows is needed")
    if o.least and o.least(int(node.param)) > node.param:
        raise PlanError(f"{node}: {o.least(int(node.param))} valid rows cannot stand in a window of {node.param}")
    if typed and o.kind == "cs" and space(node.args[0]) != "raw":
        raise PlanError(f"{node}: its input is normalised already")
    if typed and node.op in SAME_SPACE and len({space(a) for a in node.args[-2:]}) > 1:
        raise PlanError(f"{node}: inputs of different spaces")
    for a in node.args:
        check(a, columns, single, typed)


def lookback(node: Node) -> int:
    """How many earlier rows a value can depend on."""
    if not node.args:
        return 0
    own = {"window": int(node.param or 0) - 1, "delay": int(node.param or 0), "hump": 1, None: 0}[OPS[node.op].param]
    own = {"ts_momentum": own + 1, "ts_rank_corr": own}.get(node.op, own)
    return own + max(map(lookback, node.args)) + (own if node.op == "ts_rank_corr" else 0)


def unbounded(node: Node) -> bool:
    """Whether a value can depend on all earlier rows (runs have no bound)."""
    return node.op == "ts_streak" or any(map(unbounded, node.args))


def rolled_inputs(node: Node) -> set[tuple[str, int, int, str]]:
    """(column, window, least, part) of the windows that a tree takes straight from columns."""
    own = {(a.op, int(node.param), OPS[node.op].least(int(node.param)), part) for part in TAKES.get(node.op, ()) for a in node.args if not a.args}
    return own.union(*map(rolled_inputs, node.args))


def evaluate(panel: DataFrame, factors: dict[str, Node | str], single: bool = False, since: int | None = None) -> DataFrame:
    """The panel with a column for each factor. ``since``: only rows from this t are wanted; earlier ones are read as far back as windows reach."""
    nodes = {k: parse(v) if isinstance(v, str) else v for k, v in factors.items()}
    for n in nodes.values():
        check(n, set(panel.columns), single)
    df = panel
    if since is not None and not any(map(unbounded, nodes.values())):
        df = df.where(F.col("t") >= since - max(map(lookback, nodes.values())))
    made: dict[Node, Column] = {}
    count = 0

    def stage(c: Column) -> Column:
        nonlocal df, count
        name = f"__s{count}"
        count += 1
        df = df.withColumn(name, c)
        return F.col(name)

    wanted = set().union(*map(rolled_inputs, nodes.values()))
    df = rolling.with_rolling(df, wanted) if wanted else df
    stage.rolling = {(str(F.col(x)), *rest): F.col(rolling.name(x, *rest)) for x, *rest in wanted}

    def build(n: Node) -> Column:
        if not n.args:
            return F.col(n.op)
        if n not in made:
            inputs = [build(a) for a in n.args]
            # Windows look at columns, not at expressions that hold windows.
            c = OPS[n.op].build(stage, *inputs, *([] if n.param is None else [n.param]))
            made[n] = stage(c) if OPS[n.op].kind != "el" else c
        return made[n]

    for node in sorted(set(nodes.values()), key=lambda n: str(n)):
        made[node] = stage(finite(build(node)))
    return (df if since is None else df.where(F.col("t") >= since)).select(*panel.columns, *[made[n].alias(k) for k, n in nodes.items()])
