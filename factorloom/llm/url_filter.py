"""URL allow and block rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, need

#: Most rules of one filter: the trie is broadcast, so its size is bounded.
MOST_RULES = 1_000_000


class RuleTrie:
    """Rules (verdict, "host/path"): a rule fits its host and all its subdomains, where the path starts with its path.

    The rule with most host labels wins, and of these the one with the longest path; of a rule that is both allowed and
    blocked the block counts. A rule without a slash fits every path, also an empty one. Nodes are numbers and edges lie in
    two flat tables, so a rule may be as deep as it likes.
    """

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be broadcast")
        self.labels: dict[tuple[int, str], int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        #: What a path must go on with after a node's segments: the rule and its verdict; and these texts' lengths.
        self.rests: dict[int, dict[str, tuple[str, str]]] = {}
        self.lengths: dict[int, list[int]] = {}
        made = 0
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r} of rule {rule!r}")
            host, slash, path = rule.partition("/")
            *whole, rest = (slash + path).split("/")
            node = 0
            for edges, names in ((self.labels, reversed(host.translate(_LOWER).split("."))), (self.segments, whole)):
                for name in names:
                    if (node, name) not in edges:
                        made += 1
                        edges[node, name] = made
                    node = edges[node, name]
            own = self.rests.setdefault(node, {})
            if verdict == "block" or rest not in own:
                own[rest] = rule, verdict
                self.lengths[node] = sorted({len(r) for r in own}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the winning rule."""
        best, node = None, 0
        for label in reversed(host.split(".")):
            node = self.labels.get((node, label))
            if node is None:
                break
            best = self._in_path(node, path) or best
        return best

    def _in_path(self, node: int | None, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while node is not None:
            own = self.rests.get(node, {})
            best = next((own[path[at : at + n]] for n in self.lengths.get(node, ()) if path[at : at + n] in own), best)
            stop = path.find("/", at)
            node = self.segments.get((node, path[at:stop])) if stop >= 0 else None
            at = stop + 1
        return best


_LOWER = {c: c + 32 for c in range(65, 91)}


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """One row per row of ``df``: the ``keep`` columns, host, path, rule (null: none fits) and verdict.

    Where no rule fits, the verdict is ``default``. A null url, or one without ://, has an empty host and path. Urls are
    judged whole, repeated rows each; other columns are ignored, and kept ones called like a new column give way to it; an empty table gives an empty result. The trie goes to
    the executors once, in a broadcast whose size follows the rules and not the data; rows aren't shuffled.
    """
    need(df, [url, *keep])
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict"))
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf(StructType([StructField("rule", StringType()), StructField("verdict", StringType())]))
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        return pd.DataFrame([find(h, p) or (None, default) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], dtype=object)

    out = df.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = fresh(out, "_found_")
    out = out.withColumn(found, judge("host", "path"))
    return out.select(*keep, "host", "path", F.col(f"{found}.rule").alias("rule"), F.col(f"{found}.verdict").alias("verdict"))
