"""Evaluation of many factor expressions over a panel, level by level.

Expressions are read with Python's ``ast``. Every distinct call that needs a window becomes one column, whichever
expressions share it. All calls along assets that are ready are added in one step, until none is left; then all
across dates; and so on. So there is one shuffle for each change of direction, not one for each factor (and one for a level's
medians and ranks over long windows, which are streamed).
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.factor_functions import BUILT_IN, REGISTRY
from factorloom.functions.stats import TIME, clean, dealt
from factorloom.operators.rolling import rolling_orders

_PREFIX = "_col_"

#: Rows from which on medians and ranks of a window are streamed.
LONG_ORDER = 64


def parse(expression: str, columns: list[str]) -> ast.expr:
    """The tree of an expression; ``$name`` (or ``scope$name``) are columns, && and || are & and |."""

    def name(m: re.Match) -> str:
        if m[1] not in columns:
            raise KeyError(f"unknown column ${m[1]}; there are {', '.join(sorted(columns))}")
        return _PREFIX + m[1]

    text = re.sub(r"\b\w*\$(\w+)|\$(\w+)", lambda m: name(re.match(r".*\$(\w+)", m[0])), expression)
    return ast.parse(text.replace("&&", "&").replace("||", "|").strip(), mode="eval").body


def call_name(node: ast.Call) -> str:
    if not isinstance(node.func, ast.Name) or node.keywords and any(k.arg is None for k in node.keywords):
        raise ValueError("only plain calls of known functions are allowed")
    return node.func.id


@dataclass
class _Plan:
    """Columns still to be made: for each call's text its kind, and the texts it waits for."""

    calls: dict[str, tuple[str, ast.Call]] = field(default_factory=dict)
    needs: dict[str, set[str]] = field(default_factory=dict)


def _expand(node: ast.expr) -> ast.expr:
    """Calls that are compositions of others, written out."""

    class Rewrite(ast.NodeTransformer):
        def visit_Call(self, call: ast.Call) -> ast.expr:
            self.generic_visit(call)
            known = call_name(call)
            if known in ("MAX", "MIN") and len(call.args) == 2:
                a, b = call.args
                if isinstance(a, ast.Constant):
                    a, b = b, a
                return ast.Call(ast.Name(f"_{known}2"), [a, b], [])
            if known == "TS_PCTCHANGE":
                x, p = call.args[0], (call.args + [k.value for k in call.keywords])[1:] or [ast.Constant(1)]
                full = ast.Call(ast.Name("_FILL"), [x], [])
                moved = ast.Call(ast.Name("DELAY"), [full, p[0]], [])
                return ast.BinOp(ast.BinOp(full, ast.Div(), moved), ast.Sub(), ast.Constant(1.0))
            return call

    return Rewrite().visit(node)


def _collect(node: ast.expr, plan: _Plan) -> set[str]:
    """Registers the window calls in ``node``; returns those that it needs directly."""
    found: set[str] = set()
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.expr):
            found |= _collect(child, plan)
    if isinstance(node, ast.Call):
        known = REGISTRY.get(call_name(node))
        if known is None:
            raise ValueError(f"unknown function {call_name(node)}")
        if not known.least <= len(node.args) + len(node.keywords) <= known.most:
            raise ValueError(f"{call_name(node)} takes {known.least} to {known.most} arguments")
        if known.kind != "row":
            text = ast.unparse(node)
            plan.calls[text], plan.needs[text] = (known.kind, node), found
            return {text}
    return found


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.BitAnd: lambda a, b: _flag(a) & _flag(b), ast.BitOr: lambda a, b: _flag(a) | _flag(b)}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def _flag(x):
    return x if isinstance(x, Column) else F.lit(bool(x))


def _column(node: ast.expr, made: dict[str, str]) -> Column | float:
    if isinstance(node, ast.Constant):
        if isinstance(node.value, bool) or not isinstance(node.value, int | float):
            raise ValueError(f"{node.value!r} isn't a number")
        return node.value
    if isinstance(node, ast.Name):
        if not node.id.startswith(_PREFIX):
            raise ValueError(f"unknown name {node.id}")
        return F.col(f"`{node.id[len(_PREFIX):]}`").cast("double")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        value = _column(node.operand, made)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp):
        a, b = _column(node.left, made), _column(node.right, made)
        if isinstance(node.op, ast.Div):
            if not isinstance(a, Column) and not isinstance(b, Column):
                return a / b
            return F.try_divide(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))
        if type(node.op) in _BINARY:
            return _BINARY[type(node.op)](a, b)
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
        return _COMPARE[type(node.ops[0])](_column(node.left, made), _column(node.comparators[0], made))
    if isinstance(node, ast.Call):
        if (text := ast.unparse(node)) in made:
            return F.col(made[text])
        args = [_column(a, made) for a in node.args] + [_column(k.value, made) for k in node.keywords]
        if not isinstance(args[0], Column):
            raise ValueError(f"the first argument of {call_name(node)} must depend on a column")
        return REGISTRY[call_name(node)].build(*args)
    raise ValueError(f"{ast.unparse(node)} isn't allowed in an expression")


#: For each change between rows along assets and dates across them, outermost first: rows before and after; None: any number.
Span = list[tuple[int | None, int | None]]


def _wider(spans: list[Span]) -> Span:
    """The least span that holds all of ``spans``."""
    widest = lambda rows: None if None in rows else max(rows)
    return [tuple(widest([s[i][side] if i < len(s) else 0 for s in spans]) for side in (0, 1)) for i in range(max(map(len, spans), default=1))]


def _span(node: ast.expr, leaf: Span) -> Span:
    if isinstance(node, ast.Name):
        return leaf
    if not isinstance(node, ast.Call):
        return _wider([[(0, 0)], *(_span(c, leaf) for c in ast.iter_child_nodes(node) if isinstance(c, ast.expr))])
    args = [*node.args, *(k.value for k in node.keywords)]
    below, known = _wider([[(0, 0)], *(_span(a, leaf) for a in args)]), REGISTRY[call_name(node)]
    if known.kind == "date":
        return [(0, 0), *below]
    if known.kind == "asset":
        numbers = [_column(a, {}) for a in args if not any(isinstance(n, ast.Name) for n in ast.walk(a))]
        own = known.reach(*numbers) if known.reach else (None, None)
        return [tuple(None if None in (a, b) else a + b for a, b in zip(own, below[0], strict=True)), *below[1:]]
    return below


def reach(expression: str, columns: list[str], made: tuple[int | None, int | None] = (0, 0)) -> Span:
    """How far the value of a row can depend on other rows: windows along a path of the tree add up, those on different paths
    don't. ``made``: rows before and after that the panel's own columns were made of."""
    return _span(_expand(parse(expression, columns)), [(0, 0)] if made == (0, 0) else [(0, 0), made])


def with_factors(panel: DataFrame, expressions: dict[str, str], keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``panel`` with a double column for each expression, and the reasons of those that can't be evaluated.

    Infinite or undefined values are null at once, also inside an expression. A factor replaces a panel column of the
    same name only after all factors are computed. ``keep``: the panel's columns to return (all, if not given).
    """
    plan, trees, failed = _Plan(), {}, {}
    for name, text in expressions.items():
        own = _Plan()
        try:
            tree = _expand(parse(text, panel.columns))
            needs = _collect(tree, own)
            trial = {t: "x" for t in own.calls}
            for _, node in own.calls.values():  # arguments are checked here, so that one bad factor stops none
                REGISTRY[call_name(node)].build(*[_column(a, trial) for a in node.args], *[_column(k.value, trial) for k in node.keywords])
            _column(tree, trial)
        except (SyntaxError, ValueError, KeyError, TypeError, AttributeError, IndexError) as e:
            failed[name] = f"{type(e).__name__}: {e}"
            continue
        trees[name] = tree, needs
        plan.calls |= own.calls
        plan.needs |= own.needs
    made: dict[str, str] = {}
    todo, out, kind = dict(plan.calls), panel, "asset"
    while todo:
        ready = {t: n for t, (k, n) in todo.items() if k == kind and plan.needs[t] <= made.keys()}
        if not ready:
            kind = "date" if kind == "asset" else "asset"
            continue
        if kind == "date":
            out = dealt(out, TIME)
        names = {t: f"_f{len(made) + i}" for i, t in enumerate(ready)}
        orders = {names[t]: (*found, n.args[0]) for t, n in ready.items() if (found := _long_order(n))}
        out = out.withColumns({names[t]: _windowed(n, made) for t, n in ready.items() if names[t] not in orders})
        if orders:
            out = out.withColumns({f"{c}_of": clean(_column(x, made)) for c, (_, _, x) in orders.items()})
            out = rolling_orders(out, {c: (what, f"{c}_of", p) for c, (what, p, _) in orders.items()}).drop(*(f"{c}_of" for c in orders))
        made |= names
        for t in ready:
            del todo[t]
    values = {}
    for name, (tree, _) in trees.items():
        value = _column(tree, made)
        value = value if isinstance(value, Column) else F.lit(float(value))
        value = value.cast("double")
        values[name] = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    kept = [c for c in (keep or panel.columns) if c not in values]
    return out.select(*(F.col(f"`{c}`") for c in kept), *(v.alias(k) for k, v in values.items())), failed


def _long_order(node: ast.Call) -> tuple[str, int] | None:
    """Which order statistic of how many rows a call asks for, if that is better streamed than gathered for each row."""
    what = {"TS_MEDIAN": "median", "TS_RANK": "rank"}.get(call_name(node))
    size = node.args[1] if len(node.args) > 1 else node.keywords[0].value if node.keywords else None
    if what and REGISTRY[call_name(node)] is BUILT_IN[call_name(node)] and isinstance(size, ast.Constant) and size.value >= LONG_ORDER:
        return what, int(size.value)
    return None


def _windowed(node: ast.Call, made: dict[str, str]) -> Column:
    args = [_column(a, made) for a in node.args] + [_column(k.value, made) for k in node.keywords]
    return REGISTRY[call_name(node)].build(*args)


def shape(expression: str) -> tuple[int, int, int, int, int, list[str], list[str]] | None:
    """(nodes, depth, numbers, all nodes, depth of all nodes, variables, functions) of an expression; null if it can't be read.

    All nodes are those of the syntax tree from its root, with names of functions, operators and contexts.
    """
    try:
        tree = ast.parse(re.sub(r"\b\w*\$(\w+)|\$(\w+)", lambda m: _PREFIX + m[0].rpartition("$")[2], expression).replace("&&", "&").replace("||", "|").strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError):
        return None
    names, functions, numbers = [], [], 0

    def walk(node: ast.expr) -> tuple[int, int]:
        nonlocal numbers
        if isinstance(node, ast.Constant):
            numbers += 1
        if isinstance(node, ast.Name) and node.id.startswith(_PREFIX):
            names.append(node.id.removeprefix(_PREFIX))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            functions.append(node.func.id)
        children = [c for c in ast.iter_child_nodes(node) if isinstance(c, ast.expr) and not (isinstance(node, ast.Call) and c is node.func)]
        below = [walk(c) for c in children]
        return 1 + sum(n for n, _ in below), 1 + max((d for _, d in below), default=0)

    def deep(node: ast.AST) -> int:
        return 1 + max((deep(c) for c in ast.iter_child_nodes(node)), default=0)

    try:
        (nodes, depth), levels = walk(tree.body), deep(tree)
    except RecursionError:
        return None
    return nodes, depth, numbers, sum(1 for _ in ast.walk(tree)), levels, sorted(set(names)), functions
