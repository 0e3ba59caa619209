"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a host-and-path prefix (``example.com/en/7``: that host and its subdomains, paths that start so) or a pattern
over ``host + path`` in which ``*`` stands for any text and ``^`` for one separator or an end. Each rule is compiled to a
regular expression and filed under one literal token, of those it must contain the one that the fewest urls have. A url's
own tokens fetch the candidate rules; only these run their expressions. Rules without a whole literal token are tried on
every url. Of the fitting prefix rules the longest decides; without one the first fitting pattern rule (by length, then
text) blocks, else the url is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; an empty table
gives an empty result; repeated rows are judged each; other columns of the input are not touched; a column to keep that is named like one of the result's is an error.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.llm.common import LOWER, UPPER, small_batches, table

TOKEN = re.compile(r"[a-z0-9]+")
#: The base rules: verdict and host/path prefix.
BASE = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The method's own block list.
PATTERNS = ("^free-bets^", "^casino^", "^ads-track^", "^adserver^", "^spam-farm^", "^phish^", "^xxx^", "/click^", "^porn^")
_TO_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    kind: str  # prefix or pattern
    regex: str
    tokens: frozenset[str]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut].translate(_TO_LOWER), rest[cut:]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:cut]


def prefix_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    # The last token of the path may go on in the url, unless a separator ends it.
    inner = [m.group() for m in TOKEN.finditer(path.lower()) if m.end() < len(path)] if path.isascii() else []
    return Rule(text, verdict, "prefix", rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", frozenset(TOKEN.findall(host)) | frozenset(inner))


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_%]|^|$)"}
    regex = ".*" + "".join(parts.get(c) or re.escape(c) for c in text)
    whole = []
    for m in TOKEN.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before not in ("", "*") and after not in ("", "*"):
            whole.append(m.group())
    return Rule(text, verdict, "pattern", regex, frozenset(whole))


def token_counts(urls: DataFrame, column: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many urls each token of the rules occurs. The result has at most as many rows as the rules have tokens."""
    if not tokens:
        return {}
    # Rule tokens are the small side, bounded by the rule list; only hits leave the scan.
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string"))
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"[a-z0-9]+"), F.lit(0)))).alias("token")).join(wanted, "token")
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = list(rules)
        for k, r in enumerate(self.rules):
            if r.tokens:
                self.by_token[min(sorted(r.tokens), key=lambda t: counts.get(t, 0))].append(k)
            else:
                self.always.append(k)
        self.compiled: dict[int, re.Pattern] = {}

    def fits(self, k: int, target: str) -> bool:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rules[k].regex, re.DOTALL)
        return self.compiled[k].match(target) is not None

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        host, path = split_url(url)
        if not host and not path:
            return host, path, None, "allow", None
        target, lowered = host + path, (host + path).translate(_TO_LOWER)
        tried = {k for t in set(TOKEN.findall(lowered)) for k in self.by_token.get(t, ())}.union(self.always)
        best: Rule | None = None
        own: Rule | None = None
        for k in tried:
            r = self.rules[k]
            if r.kind == "prefix":
                if (best is None or (len(r.text), r.text) > (len(best.text), best.text)) and self.fits(k, target):
                    best = r
            elif (own is None or (len(r.text), r.text) > (len(own.text), own.text)) and self.fits(k, lowered):
                own = r
        verdict = best.verdict if best else own.verdict if own else "allow"
        return host, path, best.text if best else None, verdict, own.text if own else None


def filter_urls(pages: DataFrame, column: str = "url", base: Sequence[tuple[str, str]] = BASE, patterns: Sequence[str] = PATTERNS, keep: Sequence[str] = ("page_id",), max_rules: int = 200_000) -> DataFrame:
    """The columns ``keep`` of every row, then host, path, rule, verdict and pattern (the fitting pattern rule).

    The rules travel to each task with the function; that is a list the caller states, checked against ``max_rules``. A
    longer list is to be split and the verdicts of its parts combined by rule length.
    """
    rules = [prefix_rule(*r) for r in base] + [pattern_rule(p) for p in patterns]
    if clash := {"host", "path", "rule", "verdict", "pattern"}.intersection(keep):
        raise ValueError(f"columns to keep that the result has too: {', '.join(sorted(clash))}")
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the bound is {max_rules}")
    small_batches(pages.sparkSession, 4096)
    narrow = pages.select(*keep, F.col(column).cast("string").alias("__url"))
    index = RuleIndex(rules, token_counts(narrow, "__url", sorted(set().union(*(r.tokens for r in rules)))))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [index.judge(u if isinstance(u, str) else None) for u in b["__url"]]
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "pattern"], index=b.index)
            yield pd.concat([b[list(keep)], out], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*keep).schema)
    return narrow.mapInPandas(judged, f"{kept}, host string, path string, rule string, verdict string, pattern string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB: every rule tried on every url."""
    base = ", ".join(f"('{v}', '{t}', '{t.split('/')[0]}', '/{t.split('/', 1)[1]}')" for v, t in BASE)
    own = ", ".join("('" + p + "', '" + pattern_rule(p).regex.replace("'", "''") + "')" for p in PATTERNS)
    return f"""
WITH base(verdict, rule, rhost, rpath) AS (VALUES {base}), own(pattern, re) AS (VALUES {own}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM s JOIN base
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
o AS (SELECT page_id, arg_max(pattern, (length(pattern), pattern)) AS pattern FROM s JOIN own
  ON regexp_matches(lower(host || path), '^' || re) GROUP BY page_id)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN o.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, o.pattern AS pattern
FROM s LEFT JOIN b USING (page_id) LEFT JOIN o USING (page_id)"""
