"""URL filters by token-indexed pattern rules, in DataFrame functions only.

Every rule names literal tokens; the one that the rule list uses least is its key. The index is an
array of buckets, a token's bucket being its hash modulo the number of buckets, so fetching the
candidates of a token is one array access. A URL's distinct tokens fetch candidates, and only these
run their regular expressions. All of it is one projection: no join, no shuffle, no state, so hot
hosts and long URLs cost what their own tokens cost. The index is a literal built from the rule list,
which the driver already holds.

Defined cases: a null URL or one without '://' has empty host and path, fits no rule and is allowed;
of fitting rules the longest (host and path) wins, of equally long ones the smaller text; repeated
rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """host and path of a prefix rule, or name of a pattern rule; pattern runs on 'host/path'."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    fixed: bool = True


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with path."""
    host = host.lower()  # hosts of URLs are lower-cased, paths aren't; tokens of both are
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # Only tokens that are whole in every URL that fits can be keys: those of the host, and those of the
    # path that something else follows.
    whole = _TOKEN.findall(host) + _TOKEN.findall(re.sub(r"[a-z0-9]+$", "", path.lower()))
    return Rule(f"{host}{path}", verdict, pattern, tuple(dict.fromkeys(whole)))


def pattern_rule(name: str, verdict: str, pattern: str, tokens: Sequence[str]) -> Rule:
    """A pattern of the method's own; each of tokens is in every URL that fits."""
    return Rule(name, verdict, pattern, tuple(t.lower() for t in tokens), fixed=False)


#: Host names of link farms that the method blocks by itself where no prefix rule speaks.
METHOD_RULES = (
    pattern_rule("casino", "block", r"^[^/]*\bcasino\b", ["casino"]),
    pattern_rule("bets", "block", r"^[^/]*\bfree-bets\b", ["free", "bets"]),
    pattern_rule("pills", "block", r"^[^/]*\bcheap-pills\b", ["cheap", "pills"]),
    pattern_rule("spam", "block", r"^[^/]*\bspam-farm\b", ["spam", "farm"]),
)


def rarest_token(rules: Sequence[Rule]) -> list[str]:
    """Each rule's key: of its tokens the one that the fewest rules use, ties by text; '' for a rule without tokens."""
    use = Counter(t for r in rules for t in set(r.tokens))
    return [min(r.tokens, key=lambda t: (use[t], t), default="") for r in rules]


def index(rules: Sequence[Rule], buckets: int) -> list[list[dict]]:
    """Buckets of rules by the hash of their keys; the hash is the engine's xxhash64 of the token."""
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for rule, key in zip(rules, rarest_token(rules), strict=True):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        h -= (h >> 63) << 64
        table[h % buckets].append({"key": key, "name": rule.name, "verdict": rule.verdict, "pattern": rule.pattern, "fixed": rule.fixed})
    return table


def host_and_path(url: Column) -> tuple[Column, Column]:
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], method_rules: Sequence[Rule] = METHOD_RULES, id_column: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) of every URL; one scan, one projection.

    rule: the longest fitting prefix rule. verdict: that rule's, else block if a pattern rule of the
    method fits, else allow.
    """
    listed = [*rules, *method_rules]
    buckets = max(1, 2 * len(listed))
    kind = "array<array<struct<key:string,name:string,verdict:string,pattern:string,fixed:boolean>>>"
    table = F.from_json(F.lit(json.dumps(index(listed, buckets))), kind)
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_column), F.col("url")).select(id_column, host.alias("host"), path.alias("path"))
    whole = F.concat("host", "path")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(r"([a-z0-9]+)"), 1))
    if any(not r.tokens for r in listed):  # such rules are candidates of every URL
        tokens = F.concat(tokens, F.array(F.lit("")))
    fetched = F.transform(
        tokens,
        lambda t: F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")), lambda r: r["key"] == t),
    )
    fitting = F.filter(F.flatten(fetched), lambda r: F.rlike(whole, r["pattern"]))
    judged = parts.select(id_column, "host", "path", fitting.alias("fitting"))
    fixed = F.filter("fitting", lambda r: r["fixed"])
    best = F.array_min(F.transform(fixed, lambda r: F.struct((-F.length(r["name"])).alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    own = F.array_min(F.transform(F.filter("fitting", lambda r: ~r["fixed"]), lambda r: F.struct(r["name"].alias("name"), r["verdict"].alias("verdict"))))
    judged = judged.select(id_column, "host", "path", best.alias("best"), own.alias("own"))
    return judged.select(
        id_column, "host", "path", F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", "own.verdict", F.lit("allow")).alias("verdict"), F.col("own.name").alias("pattern_rule"),
    )
