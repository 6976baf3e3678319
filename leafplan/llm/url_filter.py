"""URL filters: pattern rules indexed by their rarest literal token.

Each rule has literal tokens (runs of ASCII letters and digits) that every URL
it fits must contain as whole tokens. The rule is filed under the one of them
that is rarest in the table. A URL's tokens fetch candidate rules from this
index, and only the candidates' regular expressions run. All of it is built of
DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An index of up to so many tokens is a constant in the plan; a larger one is joined.
INLINE_TOKENS = 256


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path; ``literals`` are tokens it can't fit without.

    ``site`` rules come before all others; among those that fit, the longest
    ``name`` wins, then the first in order of names.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: bool = False


def site_rule(rule: str, verdict: str) -> UrlRule:
    """A rule ``host/path``: fits the host and its subdomains where the path starts with ``/path``."""
    host, slash, path = rule.partition("/")
    # The last token of a path counts only if the rule ends it.
    ended = re.findall(r"[a-z0-9]+(?=[^a-zA-Z0-9])", path.lower())
    return UrlRule(rule, verdict, rf"^([^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(dict.fromkeys([*re.findall(r"[a-z0-9]+", host.lower()), *ended])), True)


def parse_rules(text: str) -> list[UrlRule]:
    """Rules from a list, one on each line; empty lines and those that begin with ``#`` are left out.

    ``block example.com/en/`` and ``allow example.com/`` are site rules. A rule
    whose place begins with ``~``, as in ``block ~cheap-pills``, fits where its
    words stand in that order, joined by ``-``, between ``.``, ``/`` or ``-``,
    in host or path. Of equal rules the first counts; equal places with different
    verdicts are an error.
    """
    found: dict[str, UrlRule] = {}
    for line in text.splitlines():
        verdict, _, name = line.strip().partition(" ")
        name = name.strip()
        if not verdict or verdict.startswith("#"):
            continue
        if verdict not in ("allow", "block") or not name:
            raise ValueError(f"not a rule: {line!r}")
        if name.startswith("~"):
            words = name[1:].strip()
            rule = UrlRule(words, verdict, rf"(^|[./-]){re.escape(words)}[./-]", tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", words))))
            if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", words):
                raise ValueError(f"not a rule: {line!r}")
        else:
            rule = site_rule(name if "/" in name else name + "/", verdict)
        if found.setdefault(rule.name, rule).verdict != verdict:
            raise ValueError(f"two verdicts for {rule.name!r}")
    return list(found.values())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))


def rarest_tokens(tokens: DataFrame, rules: Sequence[UrlRule]) -> dict[str, str]:
    """The rarest literal of each rule by the number of URLs that have it.

    ``tokens`` has a column of that name. Only tokens that some rule has are
    counted, so what reaches the driver is bounded by the rules.
    """
    asked = sorted({t for r in rules for t in r.literals})
    if not asked:
        return {}
    ask = tokens.sparkSession.createDataFrame([(t,) for t in asked], "token string")
    found = tokens.select(F.explode("tokens").alias("token")).join(F.broadcast(ask), "token", "left_semi").groupBy("token").count().collect()
    seen = {r["token"]: r["count"] for r in found}
    return {r.name: min(r.literals, key=lambda t: (seen.get(t, 0), t)) for r in rules if r.literals}


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule], *, otherwise: str = "allow", inline_tokens: int = INLINE_TOKENS) -> DataFrame:
    """Adds ``host, path, rule, pattern, verdict`` to ``pages`` (which has ``url``).

    ``rule`` names the winning site rule, ``pattern`` the winning other rule if
    no site rule fits; both null if none does, and then the verdict is
    ``otherwise``. A null or odd URL has empty host and path and fits no rule
    that has a literal. Repeated rows are judged alike, long URLs are read whole,
    an empty table gives an empty one, and input columns named like a new one,
    without regard to case, are left out.

    An index of over ``inline_tokens`` tokens is joined to the distinct places
    of the URLs; rows without a place, however many, don't meet in one task.
    """
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rules need names of their own")
    held = without(pages, ["host", "path", "rule", "pattern", "verdict"])
    host, path = host_and_path(quoted("url").cast("string"))
    base = held.withColumns({"host": host, "path": path}).withColumn("__lp_at", F.concat("host", "path"))
    base = base.withColumn("__lp_tokens", _tokens(F.col("__lp_at")))
    filed = rarest_tokens(base.select(F.col("__lp_tokens").alias("tokens")), rules)

    ranked = {r.name: i for i, r in enumerate(sorted(rules, key=lambda r: (not r.site, -len(r.name), r.name)))}
    kind = "array<struct<rank:int,name:string,verdict:string,regex:string,site:boolean>>"
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(filed.get(r.name, ""), []).append(r)
    one = lambda r: F.struct(F.lit(ranked[r.name]).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("regex"), F.lit(r.site).alias("site"))
    always = F.array(*[one(r) for r in index.pop("", [])]).cast(kind)

    if len(index) <= inline_tokens:
        if index:
            table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*[one(r) for r in rs]).cast(kind))])
            fetched = F.flatten(F.filter(F.transform("__lp_tokens", lambda t: F.element_at(table, t)), lambda x: x.isNotNull()))
        else:
            fetched = F.array().cast(kind)
        fitting = F.filter(F.concat(fetched, always), lambda r: F.regexp_like(F.col("__lp_at"), r["regex"]))
        judged = base.withColumn("__lp_won", F.array_min(fitting))
    else:
        rows = [(t, ranked[r.name], r.name, r.verdict, r.pattern, r.site) for t, rs in index.items() for r in rs]
        schema = T.StructType([T.StructField(n, k) for n, k in (("token", T.StringType()), ("rank", T.IntegerType()), ("name", T.StringType()), ("verdict", T.StringType()), ("regex", T.StringType()), ("site", T.BooleanType()))])
        table = pages.sparkSession.createDataFrame(rows, schema)
        ats = base.select("__lp_at").where("__lp_at <> ''").distinct()
        asked = ats.withColumn("token", F.explode(_tokens(F.col("__lp_at"))))
        fits = asked.join(table, "token").where(F.regexp_like("__lp_at", "regex"))
        best = fits.groupBy("__lp_at").agg(F.min(F.struct("rank", "name", "verdict", "regex", "site")).alias("__lp_best"))
        more = F.array_min(F.filter(always, lambda r: F.regexp_like(F.col("__lp_at"), r["regex"])))
        # An empty place fits nothing of the index: its rows are dealt evenly, to find no partner.
        lone = F.when(F.col("__lp_at") == "", F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
        best = best.withColumn("__lp_lone", F.lit(0).cast("long"))
        judged = base.withColumn("__lp_lone", lone).join(best, ["__lp_at", "__lp_lone"], "left").withColumn("__lp_won", F.least("__lp_best", more))
    won = F.col("__lp_won")
    return judged.select(
        *[quoted(c) for c in held.columns],
        "host",
        "path",
        F.when(won["site"], won["name"]).alias("rule"),
        F.when(~won["site"], won["name"]).alias("pattern"),
        F.coalesce(won["verdict"], F.lit(otherwise)).alias("verdict"),
    )
