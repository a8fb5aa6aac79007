"""Libraries of factors as tables: rules on expressions, similarity, gates, audits, rankings and merges.

A library has run_id, loop_round, intra_loop_index, factor_name, factor_expression, factor_file and metrics, a map.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from factorloom.functions.factor_functions import REGISTRY
from factorloom.functions.stats import strip
from factorloom.operators.factors import shape
from factorloom.sources.files import bare, first_of

#: Functions that expressions may not use, and functions whose last whole number is a window.
UNSUPPORTED = ["TS_SKEW", "EMA", "SMA", "POW", "SQRT", "FILTER"]
WINDOWED = ["DELTA", "DELAY", "TS_MEAN", "TS_SUM", "TS_RANK", "TS_ZSCORE", "TS_MEDIAN", "TS_PCTCHANGE", "TS_MIN", "TS_MAX", "TS_STD", "WMA", "TS_CORR"]
NORMALISERS = ["ZSCORE", "RANK", "TS_RANK", "TS_ZSCORE"]
#: Calls that count as conditions, and characters that make an expression a comparison.
CONDITIONS = ["IIF", "IF", "IFELSE"]
COMPARISONS = ["==", "!=", "<", ">"]
MIN_WINDOW, MAX_WINDOW = 2, 120
#: Limits of a candidate's tree, where every node counts.
MAX_NODES, MAX_DEPTH = 40, 8
PUBLIC = sorted({f for f in REGISTRY if not f.startswith("_")} | {"TS_PCTCHANGE"})
_KEY = ["run_id", "loop_round", "intra_loop_index"]


def metric(metrics: str, *names: str) -> Column:
    """The first of several names that the metrics map has, as a number."""
    return F.coalesce(*(F.col(metrics)[n].try_cast("double") for n in names))


def numeric_metrics(metrics: Column) -> Column:
    """The entries of a map of strings that are numbers."""
    return F.map_filter(F.transform_values(metrics, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())


def spread(library: DataFrame) -> DataFrame:
    """``library`` with its rows dealt over all cores: a file of expressions is small in bytes, so one task would read and parse them all."""
    return library.repartition(4 * library.sparkSession.sparkContext.defaultParallelism)


def each_once(f: Callable, texts: pd.Series) -> list:
    """``f`` of each text, called once for equal texts of a batch."""
    found = {x: f(x) for x in texts.unique()}
    return [found[x] for x in texts]


def slug(text: Column) -> Column:
    """Letters and digits in lower case, everything between them as one _; at most 80 characters; ``expression`` for nothing."""
    core = F.substring(F.btrim(F.regexp_replace(text, r"(?U)[^\p{Alnum}]+", "_"), F.lit("_")), 1, 80)
    return F.lower(F.when(core == "", "expression").otherwise(core))


def file_name(library: DataFrame) -> Column:
    """The name of a record's code file: run, round, index and the expression's slug; null without an expression."""
    run, e = F.trim(F.coalesce("run_id", F.lit(""))), strip(F.coalesce("factor_expression", F.lit("")))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string") if c in library.columns else F.lit("0")
    return F.when(e != "", F.concat(F.when(run != "", F.concat(run, F.lit("_"))).otherwise(""), number("loop_round"), F.lit("_"), number("intra_loop_index"), F.lit("_"), slug(e), F.lit(".py")))


def factor_id(expression: Column) -> Column:
    return F.substring(F.md5(expression), 1, 16)


def document_id(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def windows_of(expression: str) -> list[tuple[str, int]]:
    """(function, window) of each windowed call that ends in a whole number, also in nested calls."""
    import ast

    try:
        tree = ast.parse(re.sub(r"\$(\w+)", r"_col_\1", expression or "").replace("&&", "&").replace("||", "|").strip(), mode="eval")
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id.upper() in WINDOWED:
            numbers = [a.value for a in [*node.args, *(k.value for k in node.keywords)] if isinstance(a, ast.Constant) and isinstance(a.value, int | float) and a.value == int(a.value)]
            if numbers:
                out.append((node.func.id.upper(), int(numbers[-1])))
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _windows(expression: pd.Series) -> pd.Series:
    return pd.Series(each_once(lambda x: [n for _, n in windows_of(x)], expression))


_SHAPE = ["nodes", "depth", "numbers", "all_nodes", "all_depth", "variables", "functions"]


@F.pandas_udf(StructType([*(StructField(c, IntegerType()) for c in _SHAPE[:5]), *(StructField(c, ArrayType(StringType())) for c in _SHAPE[5:])]))
def expression_shape(expression: pd.Series) -> pd.DataFrame:
    """Nodes, depth, numbers, variables and functions of an expression; all null where it can't be read.

    ``all_nodes`` and ``all_depth`` also count the nodes for names of functions, for operators and for reading a name.
    """
    none = (None,) * len(_SHAPE)
    return pd.DataFrame(each_once(lambda x: shape(x) or none if x else none, expression), columns=_SHAPE).astype(dict.fromkeys(_SHAPE[:5], "Int32"))


def _cancels(tokens: list[str]) -> bool:
    """Whether a column is divided by itself, or subtracted from itself alone in brackets (a number may follow)."""
    for i, t in enumerate(tokens):
        if not t.startswith("$") or tokens[i + 2 : i + 3] != [t]:
            continue
        if tokens[i + 1] == "/":
            return True
        if tokens[i + 1] == "-" and tokens[i - 1 : i] == ["("]:
            rest = tokens[i + 3 : i + 6]
            if rest[:1] == [")"] or len(rest) == 3 and rest[0] in "+-" and rest[1][0] in ".0123456789" and rest[2] == ")":
                return True
    return False


@F.pandas_udf(BooleanType())
def self_cancelling(expression: pd.Series) -> pd.Series:
    token = re.compile(r"\$\w+|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|\w+|\S")
    return pd.Series(each_once(lambda x: _cancels(token.findall((x or "").lower())), expression))


@F.pandas_udf(StringType())
def repair_windows(expression: pd.Series) -> pd.Series:
    """Clamps the last whole number of each windowed call to the allowed range."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, opened, named = list(text), [], None
        for m in re.finditer(r"[(),]|[A-Za-z_]\w*\s*(?=\()", text):
            if m[0] == "(":
                opened.append([named, m.end(), []])
                named = None
            elif m[0] == ")" and opened:
                name, begin, commas = opened.pop()
                if (name or "").upper() in WINDOWED:
                    edges = [begin, *commas, m.start() + 1]
                    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
                        part = text[a : b - 1].strip()
                        if re.fullmatch(r"[+-]?\d+(\.0*)?", part):
                            at = text.index(part, a)
                            out[at : at + len(part)] = [str(min(max(int(float(part)), MIN_WINDOW), MAX_WINDOW)), *[""] * (len(part) - 1)]
                            break
            elif m[0] == ",":
                if opened:
                    opened[-1][2].append(m.end())
            else:
                named = m[0].strip()
        return "".join(out)

    return pd.Series(each_once(one, expression))


def _first_reason(rules: list[tuple[str | Column, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for reason, bad in reversed(rules):
        out = F.when(bad, reason if isinstance(reason, Column) else F.lit(reason)).otherwise(out)
    return out


def words(values) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def variables_of(e: Column) -> Column:
    """The distinct columns ($name) of an expression, in order."""
    return F.array_distinct(F.regexp_extract_all(e, F.lit(r"\$([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def calls_of(e: Column) -> Column:
    """The distinct names that are called in an expression, in upper case and in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(e, F.lit(r"(?<![\w$])([A-Za-z_]\w*)\s*\("), F.lit(1)), F.upper))


def rule_check(library: DataFrame, columns: list[str], expression: str = "factor_expression", least: int = MIN_WINDOW, most: int = MAX_WINDOW) -> DataFrame:
    """Adds ``rejected``: the first rule that an expression breaks (null: none), in this order: empty, unsupported function,
    condition, comparison, unknown column, window too small or too large."""
    e = F.col(expression)
    unknown = F.array_except(variables_of(e), words(c.lstrip("$") for c in columns)) if columns else words(())
    unsupported = F.array_intersect(calls_of(e), words(UNSUPPORTED))
    found = spread(library).withColumn("_w", _windows(F.coalesce(e, F.lit(""))))
    rules = [
        ("empty", F.trim(F.coalesce(e, F.lit(""))) == ""),
        (F.concat(F.lit("unsupported_function:"), F.get(unsupported, F.lit(0))), F.size(unsupported) > 0),
        ("condition", F.arrays_overlap(calls_of(e), words(CONDITIONS))),
        ("comparison", reduce(lambda a, c: a | F.contains(e, F.lit(c)), COMPARISONS, F.lit(False))),
        (F.concat(F.lit("unknown_column:"), F.get(unknown, F.lit(0))), F.size(unknown) > 0),
        ("window_too_small", F.exists("_w", lambda n: n < least)),
        ("window_too_large", F.exists("_w", lambda n: n > most)),
    ]
    return found.withColumn("rejected", _first_reason(rules)).drop("_w")


def candidate_check(library: DataFrame, columns: list[str], expression: str = "factor_expression", max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Adds ``invalid``: empty, unknown column, nested normaliser, column that cancels itself, unreadable, too many nodes, too
    deep, unknown function; null where none applies. Every node of the tree counts, also those that name functions or
    operators."""
    e = F.col(expression)
    unknown = F.array_except(variables_of(e), words(c.lstrip("$") for c in columns))
    nested = reduce(lambda a, n: a | e.rlike(rf"(?i)\b{n}\s*\(\s*{n}\s*\("), NORMALISERS, F.lit(False))
    found = spread(library).withColumns({"_s": expression_shape(F.coalesce(e, F.lit(""))), "_c": self_cancelling(e)})
    known = words({f.upper() for f in REGISTRY if not f.startswith("_")} | {f.upper() for f in PUBLIC})  # also those registered since
    odd = F.filter(F.col("_s.functions"), lambda f: ~F.array_contains(known, F.upper(f)))
    rules = [
        ("empty_expression", strip(F.coalesce(e, F.lit(""))) == ""), (F.concat(F.lit("unknown_column:$"), F.get(unknown, F.lit(0))), F.size(unknown) > 0), ("recursive_normalization", nested), ("degenerate_self_operation", F.col("_c")),
        ("syntax_error", F.col("_s.nodes").isNull()), ("expression_too_many_nodes", F.col("_s.all_nodes") > max_nodes), ("expression_too_deep", F.col("_s.all_depth") > max_depth), (F.concat(F.lit("unknown_function:"), F.get(odd, F.lit(0))), F.size(odd) > 0),
    ]
    return found.withColumn("invalid", _first_reason(rules)).drop("_s", "_c")


def lexical_check(library: DataFrame, columns: list[str], expression: str = "factor_expression") -> DataFrame:
    """Adds ``lexical``: unbalanced parentheses, runs of operators, unknown characters, functions or variables, no variable."""
    e = F.col(expression)
    count = lambda c: F.length(e) - F.length(F.replace(e, F.lit(c), F.lit("")))
    calls, variables = calls_of(e), variables_of(e)
    rules = [
        ("unbalanced_parentheses", count("(") != count(")")), ("operator_run", e.rlike(r"[*/]\s*[*/]|[+*/-]\s*[*/)]|[+*/(-]\s*$")), ("illegal_character", e.rlike(r"[^\w\s$+\-*/(),.&|<>=!]")),
        ("unknown_function", F.size(F.array_except(calls, words(f.upper() for f in PUBLIC))) > 0), ("unknown_variable", F.size(F.array_except(variables, words(columns))) > 0), ("no_variable", F.size(variables) == 0),
    ]
    return library.withColumn("lexical", _first_reason(rules))


def acceptable_shape(library: DataFrame, expression: str = "factor_expression", references: DataFrame | None = None, max_length: int = 250, max_features: int = 6, max_number_share: float = 0.5, max_variable_share: float = 0.5, max_common: int = 8) -> DataFrame:
    """Adds the shape of each expression, the size of its largest sub-expression in common with ``references`` (0 without any) and
    whether it is acceptable: readable, short, of few variables, less than half of it numbers, less than half of it different
    variables, and no large part in common."""
    out = spread(library).withColumn("shape", expression_shape(F.coalesce(F.col(expression), F.lit(""))))
    if references is None:
        out = out.withColumn("common_size", F.lit(0))
    else:
        common = largest_common_subtree(library, references, expression).select(F.col("new").alias("_new"), F.col("size").alias("_size"))
        out = out.join(common, F.col(expression) == F.col("_new"), "left").withColumn("common_size", F.coalesce("_size", F.lit(0))).drop("_new", "_size")
    n, features = F.col("shape.nodes"), F.size("shape.variables")
    good = n.isNotNull() & (F.length(strip(F.col(expression))) <= max_length) & (features <= max_features) & (F.col("shape.numbers") < max_number_share * n) & (features < max_variable_share * n) & (F.col("common_size") <= max_common)
    return out.withColumn("acceptable", good)


def purge(library: DataFrame, columns: list[str]) -> DataFrame:
    return rule_check(library, columns).filter("rejected is null").drop("rejected")


def normal_form(expression: Column) -> Column:
    """Upper case, no white space, and every number an N."""
    return F.regexp_replace(F.upper(bare(expression)), r"\b\d+(?:\.\d+)?(?:E[+-]?\d+)?\b", "N")


def trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.array_distinct(F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array(text)))


#: Forms of either side that meet over one trigram in one task.
HOT = 5_000


def similar_expressions(new: DataFrame, library: DataFrame, threshold: float = 0.9, expression: str = "factor_expression") -> DataFrame:
    """(new_form, old_form, similarity, n_new, n_old): pairs of normal forms whose trigram sets have a Jaccard similarity of
    at least ``threshold``, and how many expressions have each. Copies aren't paired one by one.

    Forms meet in an inverted index of their rarest trigrams alone: of n trigrams, those left when threshold x n, less one,
    of the most frequent are taken away. Every pair that is similar enough shares one of them, has sizes near enough, and after the first
    that it shares has enough trigrams left; full sets are then compared. Trigrams that very many forms hold among their rarest are dealt to a
    grid of tasks, ``HOT`` forms of either side in each cell.
    """
    own = lambda d, tag: d.select(normal_form(F.col(expression)).alias(tag)).filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.count("*").alias(f"n_{tag}")).withColumn(f"g_{tag}", trigrams(F.col(tag)))
    a, b = own(new, "new"), own(library, "old")
    freq = a.select(F.explode("g_new").alias("t")).union(b.select(F.explode("g_old").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def prefix(d: DataFrame, tag: str) -> DataFrame:
        items = d.select(tag, F.size(f"g_{tag}").alias("n"), F.explode(f"g_{tag}").alias("t")).join(freq, "t")
        place = F.row_number().over(Window.partitionBy(tag).orderBy("f", "t"))
        return items.withColumn("p", place).filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("t", tag, F.col("n").alias(f"s_{tag}"), F.col("p").alias(f"p_{tag}"))

    left, right = prefix(a, "new"), prefix(b, "old")
    parts = lambda d, tag: d.groupBy("t").agg(F.ceil(F.count("*") / HOT).cast("int").alias(f"c_{tag}"))
    grid = parts(left, "new").join(parts(right, "old"), "t")  # trigrams that only one side holds go here
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda tag: F.pmod(F.xxhash64(tag), F.col(f"c_{tag}")).cast("int")
    left = left.join(grid, "t").withColumn("i", dealt("new")).withColumn("j", every("c_old")).drop("c_new", "c_old")
    right = right.join(grid, "t").withColumn("j", dealt("old")).withColumn("i", every("c_new")).drop("c_new", "c_old")
    na, nb = F.col("s_new"), F.col("s_old")
    near = F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9
    enough = 1 + F.least(na - F.col("p_new"), nb - F.col("p_old")) >= (na + nb) * (threshold / (1 + threshold)) - 1e-9
    pairs = left.join(right, ["t", "i", "j"]).filter(near & enough).select("new", "old").distinct()
    full = pairs.join(a, "new").join(b, "old")
    score = F.size(F.array_intersect("g_new", "g_old")) / F.size(F.array_union("g_new", "g_old"))
    return full.withColumn("similarity", score).filter(F.col("similarity") >= threshold).select(F.col("new").alias("new_form"), F.col("old").alias("old_form"), "similarity", "n_new", "n_old")


def _forms(text: str | None) -> dict[bytes, tuple[int, str]]:
    """Size and form of each distinct sub-expression by its hash, which follows from its label and the hashes of its operands
    (sorted, for + and *)."""
    found: dict[bytes, tuple[int, str]] = {}

    def walk(node: ast.expr) -> tuple[bytes, int, str]:
        children = [walk(c) for c in ast.iter_child_nodes(node) if isinstance(c, ast.expr) and not (isinstance(node, ast.Call) and c is node.func)]
        label = type(node.op).__name__ if isinstance(node, ast.BinOp | ast.UnaryOp) else node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else node.id if isinstance(node, ast.Name) else repr(getattr(node, "value", type(node).__name__))
        hashes, forms = [h for h, *_ in children], [f for *_, f in children]
        if label in ("Add", "Mult"):
            hashes.sort()
            forms.sort()
        key = hashlib.md5(b"".join([label.encode(), b"\0", *hashes]), usedforsecurity=False).digest()
        size, form = 1 + sum(n for _, n, _ in children), f"{label}({','.join(forms)})" if forms else label
        found[key] = size, form
        return key, size, form

    try:
        walk(ast.parse(re.sub(r"\$(\w+)", r"\1", text or "").replace("&&", "&").replace("||", "|").strip(), mode="eval").body)
    except (SyntaxError, ValueError, RecursionError):
        return {}
    return found


@F.pandas_udf(ArrayType(StructType([StructField("hash", BinaryType()), StructField("size", IntegerType())])))
def subtrees(expression: pd.Series) -> pd.Series:
    """The distinct sub-expressions of an expression as hashes, with their sizes."""
    return expression.map(lambda text: [(h, n) for h, (n, _) in _forms(text).items()])


@F.pandas_udf(StructType([StructField("old", StringType()), StructField("size", IntegerType()), StructField("form", StringType())]))
def _named(new: pd.Series, found: pd.Series) -> pd.DataFrame:
    """Of sub-expressions of one size the one with the largest form, read from the expression itself."""
    rows = []
    for text, own in zip(new, found, strict=True):
        forms = _forms(text)
        rows.append(max(((x["old"], *forms[bytes(x["hash"])]) for x in own), key=lambda r: r[2]))
    return pd.DataFrame(rows, columns=["old", "size", "form"])


def largest_common_subtree(new: DataFrame, library: DataFrame, expression: str = "factor_expression") -> DataFrame:
    """(new, old, size, form): for each new expression, the library's expression with the largest sub-expression in common.

    Sub-expressions travel as hashes of 16 bytes; their texts are made again only for the largest of each new expression.
    The library has one row for each of them, so that a common one meets a new expression once.
    """
    a = new.select(F.col(expression).alias("new")).distinct().select("new", F.explode(subtrees("new")).alias("s")).select("new", "s.hash", "s.size")
    b = library.select(F.col(expression).alias("old")).distinct().select("old", F.explode(subtrees("old")).alias("s")).select("old", "s.hash")
    b = b.groupBy("hash").agg(F.min("old").alias("old"))
    by_size = a.join(b, "hash").groupBy("new", "size").agg(F.collect_list(F.struct("hash", "old")).alias("found"))
    best = by_size.groupBy("new").agg(F.max_by("found", "size").alias("found"))
    return best.select("new", _named("new", "found").alias("m")).select("new", "m.*")


def quality_gate(new: DataFrame, library: DataFrame, columns: list[str], min_ic: float = 0.003, min_icir: float = 0.005, max_turnover: float = 0.5, min_coverage: float = 0.8, threshold: float = 0.9) -> DataFrame:
    """Adds gate (the first that a record fails) and passed: error, IC, its ratio, turnover, coverage, rules, name, expression
    similarity. A missing IC, ratio or coverage counts as 0, a missing turnover (or one of 0) as 1."""
    ic, icir = (F.coalesce(metric("metrics", *n), F.lit(0.0)) for n in (("IC", "ic", "Rank IC", "rank_ic"), ("ICIR", "icir", "Rank ICIR", "rank_icir")))
    moved, share = metric("metrics", "turnover"), F.coalesce(metric("metrics", "coverage"), F.lit(0.0))
    moved = F.when(moved.isNull() | (moved == 0), 1.0).otherwise(moved)
    out = rule_check(new, columns)
    names = library.select(F.lower("factor_name").alias("_n"), F.lit(True).alias("_known")).distinct()
    out = out.withColumn("_n", F.lower("factor_name")).join(names, "_n", "left")
    near = similar_expressions(new, library, threshold).select(F.col("new_form").alias("_form"), F.lit(True).alias("_near")).distinct()
    out = out.withColumn("_form", normal_form(F.col("factor_expression"))).join(near, "_form", "left")
    gate = _first_reason([("error", F.col("factor_expression").isNull()), ("ic", F.abs(ic) < min_ic), ("icir", F.abs(icir) < min_icir), ("turnover", moved > max_turnover), ("coverage", share < min_coverage), ("rules", F.col("rejected").isNotNull()), ("name", F.col("_known").isNotNull()), ("similarity", F.col("_near").isNotNull())])
    return out.withColumn("gate", gate).withColumn("passed", F.col("gate").isNull()).drop("_n", "_form", "_known", "_near", "rejected")


def gate_summary(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if("passed").alias("accepted"), F.count_if(~F.col("passed")).alias("rejected"), F.coalesce(F.try_divide(F.count_if("passed").cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("acceptance_rate"))


def join_metrics(implementations: DataFrame, metrics: DataFrame, rounds: DataFrame) -> DataFrame:
    """Implementations with their metrics by name without case; those of the round where there are none. Of several metrics
    of a name or round the greatest as JSON counts, so that equal tables give equal results."""
    one = lambda name: F.max_by("metrics", F.to_json("metrics")).alias(name)
    own, per_round = metrics.groupBy(F.lower("factor_name").alias("_n")).agg(one("_own")), rounds.groupBy("loop_round").agg(one("_round"))
    out = implementations.withColumn("_n", F.lower("factor_name")).join(own, "_n", "left").join(per_round, "loop_round", "left")
    return out.withColumn("metrics", F.coalesce("_own", "_round")).drop("_n", "_own", "_round")


def orphans(files: DataFrame, library: DataFrame) -> DataFrame:
    """Files that no record expects: neither its own file name nor that of its run, round, index and expression."""
    own = F.trim("factor_file")
    expected = library.select(F.explode(F.array_compact(F.array(F.when(own != "", own), file_name(library)))).alias("file")).distinct()
    return files.join(expected, "file", "left_anti")


def accept_unseen(new: DataFrame, library: DataFrame) -> DataFrame:
    """New records whose expression isn't stored yet; of equal ones the first."""
    seen = library.select(bare("factor_expression").alias("_e")).distinct()
    fresh = first_of(new, bare("factor_expression"), ["factor_name"]).withColumn("_e", bare("factor_expression"))
    return fresh.join(seen, "_e", "left_anti").drop("_e")


def union_libraries(*libraries: DataFrame) -> DataFrame:
    """All records; of equal expressions that of the first library."""
    both = None
    for i, d in enumerate(libraries):
        d = d.withColumn("_p", F.lit(i))
        both = d if both is None else both.unionByName(d, allowMissingColumns=True)
    return first_of(both, bare("factor_expression"), ["_p", "factor_name"]).drop("_p")


def recover(library: DataFrame, legacy: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(library with the legacy's missing records and file names, counts by action) by run, round and index.

    Actions of legacy records: recovered, updated_existing (a stored record gets its file name), already_present,
    unparseable_record (no run or expression), code_missing (its file isn't among ``files``). Of legacy records with the
    same key the first by name and expression counts.
    """
    made = F.when(F.trim(F.coalesce("run_id", F.lit(""))) != "", file_name(legacy))
    old = legacy.withColumn("_file", made)
    there = F.lit(True)
    if files is not None:
        old = old.join(files.select(F.col("file").alias("_file"), F.lit(True).alias("_there")).distinct(), "_file", "left")
        there = F.col("_there").isNotNull()
    skip = F.when(F.col("_file").isNull(), "unparseable_record").when(~there, "code_missing")
    old = old.withColumn("_skip", skip)
    usable = first_of(old.filter("_skip is null"), F.struct(*_KEY), ["factor_name", "factor_expression"])
    more = old.filter("_skip is null").agg((F.count("*") - F.count_distinct(F.struct(*_KEY))).alias("n"))
    stored = library.select(*_KEY, F.coalesce(F.trim("factor_file") == "", F.lit(True)).alias("_open"), F.lit(True).alias("_here")).groupBy(*_KEY).agg(F.max("_open").alias("_open"), F.max("_here").alias("_here"))
    judged = usable.join(stored, _KEY, "left").withColumn("action", F.when(F.col("_here").isNull(), "recovered").when(F.col("_open"), "updated_existing").otherwise("already_present"))
    names = judged.filter("action = 'updated_existing'").select(*_KEY, "_file")
    kept = library.join(names, _KEY, "left").withColumn("factor_file", F.when(F.coalesce(F.trim("factor_file") == "", F.lit(True)), F.coalesce("_file", "factor_file")).otherwise(F.col("factor_file")))
    new = judged.filter("action = 'recovered'").withColumn("factor_file", F.col("_file"))
    if "source" in library.columns:
        new = new.withColumn("source", F.lit("legacy_old_json_recovery"))
    new = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(library.schema[c].dataType).alias(c) for c in library.columns))
    counts = judged.groupBy("action").agg(F.count("*").alias("n"))
    counts = counts.union(old.filter("_skip is not null").groupBy(F.col("_skip")).agg(F.count("*"))).union(more.select(F.lit("already_present"), "n"))
    return kept.select(*library.columns).unionByName(new), counts.groupBy("action").agg(F.sum("n").alias("n")).filter("n > 0")


_EVENT = {"name": "string", "run_id": "string", "timestamp": None, "reason": "string", "expression": "string", "type": "string", "metrics": "map<string,string>"}


def upsert_failures(*logs: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """One row for each name and run over several logs (name, run_id, timestamp, reason, expression, and type and metrics where
    they have them): of each field the last value that isn't null, later logs after earlier ones at equal times.

    ``proposals`` (same columns) count only for names and runs that no log has: the first one of each.
    """
    some = [c for c in _EVENT if any(c in d.columns for d in (*logs, *([proposals] if proposals is not None else [])))]
    take = lambda d: d.select(*(F.col(c) if c in d.columns else F.lit(None).cast(_EVENT[c] or "timestamp").alias(c) for c in some))
    both = reduce(DataFrame.unionByName, (take(d).withColumn("src", F.lit(i)) for i, d in enumerate(logs)))
    order = F.struct("timestamp", "src", *(F.to_json(c) if c == "metrics" else F.col(c) for c in some if c not in ("name", "run_id", "timestamp")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    rest = [c for c in some if c not in ("name", "run_id")]
    out = both.groupBy("name", "run_id").agg(*(F.max(c).alias(c) if c == "timestamp" else latest(c) for c in rest))
    if proposals is None:
        return out
    fresh = first_of(take(proposals), F.struct("name", "run_id"), ["timestamp", "expression"]).join(out.select("name", "run_id"), ["name", "run_id"], "left_anti")
    fresh = fresh.withColumn("reason", F.coalesce("reason", F.lit("Proposed but results pending or rejected.")))
    return out.unionByName(fresh.withColumn("type", F.coalesce("type", F.lit("unsuccessful_attempt"))) if "type" in some else fresh)


def duplicate_expressions(library: DataFrame) -> DataFrame:
    """(expression, factor_name, n): the members of each expression that n > 1 records share, one row each."""
    return _members(library, bare("factor_expression"), "expression")


def _members(library: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows of groups of two or more, with the group's size; no group is gathered in one cell."""
    keyed = library.select(key.alias(name), "factor_name")
    shared = keyed.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(shared, name)


def duplicate_names(library: DataFrame) -> DataFrame:
    """(base_name, factor_name, n): names that differ in a number at their end only, one row each."""
    return _members(library, F.regexp_replace("factor_name", r"\s+\d+$", ""), "base_name")


def library_summary(library: DataFrame) -> DataFrame:
    return library.agg(F.count("*").alias("records"), F.count_distinct(bare("factor_expression")).alias("distinct_expressions"))


def recent(events: DataFrame, n: int, time: str = "timestamp", tie: str = "name") -> DataFrame:
    """The latest ``n`` events; those of one time and name in the order of their other columns, so that reruns agree."""
    return events.orderBy(F.desc(time), tie, *_others(events, time, tie)).limit(n)


def _others(df: DataFrame, *used: str) -> list[str]:
    """All columns that can be put in order, but those that are ``used``."""
    return [c for c, t in sorted(df.dtypes) if c not in used and not re.search("map<|variant", t)]


def recent_rejected(events: DataFrame, n: int = 50) -> DataFrame:
    """The latest ``n`` rejected factors, one row (the last) for each name."""
    return first_of(events, F.col("name"), [F.desc("timestamp"), F.desc("reason")]).orderBy(F.desc("timestamp"), "name").limit(n)


def failure_summary(events: DataFrame, last: int = 30, reasons: int = 8, names: int = 12, samples: int = 5) -> DataFrame:
    """(kind, value, n) over the most recent events: their commonest reasons and names (missing ones count as unknown), and the
    first distinct expressions among them."""
    tail = recent(events, last)
    text = lambda c: F.coalesce(F.when(strip(F.col(c)) != "", strip(F.col(c))), F.lit("unknown"))
    top = lambda c, k: tail.groupBy(text(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k).select(F.lit(c).alias("kind"), "value", "n")
    shown = tail.filter(strip(F.col("expression")) != "").groupBy(strip(F.col("expression")).alias("value")).agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "name")).alias("_at"))
    return top("reason", reasons).union(top("name", names)).union(shown.orderBy("_at", "value").limit(samples).select(F.lit("expression"), "value", "n"))


def phase_counts(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy("phase").agg(F.count("*").alias("n"))


def best_trajectories(trajectories: DataFrame, k: int = 5, names: tuple[str, ...] = ("Rank IC", "IC", "Sharpe")) -> DataFrame:
    return trajectories.withColumn("metric", metric("metrics", *names)).orderBy(F.desc_nulls_last("metric"), "trajectory_id").limit(k)


def search_summary(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by phase and status, best of each phase and generation)."""
    counts = history.groupBy("phase", "status").agg(F.count("*").alias("n"))
    best = history.groupBy("phase", "generation").agg(F.max("fitness").alias("fitness"), F.max_by("name", F.struct("fitness", "name")).alias("name"))
    return counts, best


def by_hypothesis(library: DataFrame, sharpe: float = 2.0) -> DataFrame:
    """(hypothesis, n, has_strong); the factors of each are the library's own rows."""
    s = metric("metrics", "Sharpe", "sharpe")
    return library.groupBy("hypothesis").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(s > sharpe), F.lit(False)).alias("has_strong"))


def top_factors(library: DataFrame, k: int = 10, names: tuple[str, ...] = ("Sharpe", "sharpe")) -> DataFrame:
    """The ``k`` factors with the largest absolute value of a metric; equal ones by name, then by their place in their round and their
    other columns, so that reruns agree."""
    found = library.withColumn("value", metric("metrics", *names)).filter("value is not null")
    ties = sorted(_others(library, "factor_name"), key=lambda c: c != "intra_loop_index")
    return found.orderBy(F.desc(F.abs("value")), "factor_name", *ties, "value").limit(k).select("factor_name", "value")


def candidate_pool(candidates: DataFrame, n: int = 50) -> DataFrame:
    """The best fitness of each expression, and of these the n best."""
    return first_of(candidates, bare("factor_expression"), [F.desc("fitness"), F.col("factor_name")]).orderBy(F.desc("fitness"), "factor_name").limit(n)


def rank_seeds(seeds: DataFrame, priority: DataFrame, penalty: DataFrame, memory_words: DataFrame) -> DataFrame:
    """Seeds by memory score (its numbers and words are fixed values): 100 less its rank (50 at most) in the priority list, less 50 less its rank (25 at most) in the
    penalty list, three for each of up to eight words in common with memory, and small bonuses for words in its name.

    priority and penalty: (name, place from 0); memory_words: (word).
    """
    name = F.trim("factor_name")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "factor_name", "factor_expression")), F.lit(r"[a-z_]{3,}"), F.lit(0)))
    keyed = seeds.withColumn("_k", F.xxhash64("factor_name", "factor_expression"))
    overlap = keyed.select("_k", F.explode(words).alias("word")).distinct().join(memory_words.select("word").distinct(), "word").groupBy("_k").agg(F.count("*").alias("_o"))
    listed = lambda d, c: d.groupBy(F.col("name").alias("_name")).agg(F.min("place").alias(c))
    out = keyed.join(overlap, "_k", "left").withColumn("_name", name).join(listed(priority, "_p"), "_name", "left").join(listed(penalty, "_q"), "_name", "left")
    low = F.lower(name)
    score = F.coalesce(100 - F.least("_p", F.lit(50)), F.lit(0)) - F.coalesce(50 - F.least("_q", F.lit(25)), F.lit(0)) + F.least(F.coalesce("_o", F.lit(0)), F.lit(8)) * 3
    score = score + F.contains(low, F.lit("evo")).cast("int") * 2 + low.rlike("funding|vwap|volume").cast("int") + low.rlike("reversal|momentum").cast("int")
    out = out.withColumn("memory_score", score.cast("int")).drop("_k", "_o", "_name", "_p", "_q")
    return out.orderBy(F.desc("memory_score"), F.length("factor_expression"), F.desc("factor_name"))


def discovery_log(library: DataFrame) -> DataFrame:
    return library.orderBy(*_KEY)


def rebuild(factors: DataFrame, library: DataFrame, min_ic: float = 0.003) -> DataFrame:
    """Factors of run logs that weren't rejected, with enough IC, once for each run, round and name, and not stored yet."""
    good = factors.filter(~F.coalesce("rejected", F.lit(False)) & (F.abs(metric("metrics", "IC", "ic", "Rank IC")) >= min_ic))
    return accept_unseen(first_of(good, F.struct("run_id", "loop_round", F.lower("factor_name")), ["intra_loop_index"]), library)


def audit(library: DataFrame, files: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """(check, n, advice): records, distinct expressions, duplicates, names alike, files nobody expects; and with ``logs`` (file,
    events, bad_lines, as ``read_events`` counts them) their lines and those that can be read."""
    s = library_summary(library)
    row = lambda d, check, advice: d.agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "n", F.lit(advice).alias("advice"))
    out = s.select(F.lit("records").alias("check"), F.col("records").alias("n"), F.lit("").alias("advice")).union(s.select(F.lit("distinct_expressions"), "distinct_expressions", F.lit("")))
    out = out.union(row(duplicate_expressions(library).select("expression").distinct(), "duplicate_expressions", "keep the first of each")).union(row(duplicate_names(library).select("base_name").distinct(), "duplicate_names", "merge or rename")).union(row(orphans(files, library), "orphan_files", "archive"))
    if logs is None:
        return out
    total = logs.agg(F.coalesce(F.sum(F.col("events") + F.col("bad_lines")), F.lit(0)).alias("lines"), F.coalesce(F.sum("events"), F.lit(0)).alias("good"))
    return out.union(total.select(F.lit("log_lines"), "lines", F.lit(""))).union(total.select(F.lit("log_lines_valid"), "good", F.lit("repair or drop the others")))


def knowledge_snapshot(library: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Tables of what is known: top factors, top evolved ones by rank IC, failures, counts."""
    evolved = library.filter(F.col("source") == "evolution")
    return {"top_factors": top_factors(library), "top_evolved": top_factors(evolved, 10, ("Rank IC", "rank_ic")), "failures": failure_summary(events), "counts": library_summary(library)}


def markdown_names(pages: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Linked names of the first cells of markdown tables: one row each."""
    return pages.select(*(keep or []), F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^\|\s*(?:\[)?([^|\]]+?)(?:\]\([^)]*\))?\s*\|"), F.lit(1))).alias("name")).filter(~F.col("name").rlike(r"^[-: ]+$")).select(*(keep or []), F.trim("name").alias("name"))


def ordered_union(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def resolve_signal_columns(expression: str, columns: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Panel columns that an expression's words name, directly or by alias; names of functions don't count."""
    words = [w for w in re.findall(r"[A-Za-z_]\w*", expression) if w.upper() not in {f.upper() for f in PUBLIC}]
    names = {c.lower(): c for c in columns}
    found = [names.get((aliases or {}).get(w.lower(), w.lower())) for w in words]
    return list(dict.fromkeys(f for f in found if f))


def fallback_signal(df: DataFrame, columns: list[str], name: str = "signal") -> DataFrame:
    """Mean of the columns' percentile ranks."""
    from factorloom.functions.stats import rank_pct, row_mean

    ranked = df.withColumns({f"_r_{c}": rank_pct(F.col(c)) for c in columns})
    return ranked.withColumn(name, row_mean(*(F.col(f"_r_{c}") for c in columns))).drop(*(f"_r_{c}" for c in columns))
