"""Secret scanning over a trigram inverted index.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived: what every match must contain. For
each batch of documents the postings of the needed trigrams are built in one pass over its bytes, the queries intersect and unite them, and only the
candidates run the expression. A rule without a mandatory trigram scans every text in full: a run of one character class is
looked for in one pass over the text's translated bytes, any other rule by its expression.

Spans are half-open and count code points. Matches are leftmost and do not overlap within a kind; a match that fails the
rule's length check is dropped after it was consumed.

Defined cases: a null text is an empty one and has no spans; repeated rows are scanned each; an empty table gives an empty
result; lower-casing for the index may only widen the candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.llm.common import small_batches, table

try:  # The parser of re has no public name; its tree is held to by a test.
    from re import _constants as C
    from re import _parser
except ImportError:
    import sre_constants as C
    import sre_parse as _parser


@dataclass(frozen=True)
class SecretRule:
    kind: str
    regex: str
    least: int = 0  # characters that `group` has at least
    group: int = 0


#: The base kinds, in the order in which equal starts are listed; then the method's own.
BASE = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    SecretRule("access", r"AKIA[A-Z0-9]+", 16),
    SecretRule("hex", r"[0-9a-f]+", 32),
)
MORE = (
    SecretRule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("forge_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=~-]{16,}"),
)

# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple
#: Sets of strings above this many, and strings above this length, are broken into trigrams while deriving.
MANY, LONG = 64, 24
#: Bytes whose trigrams are told apart at once.
SLICE = 1 << 22


def both(op: str, parts: Sequence[Query]) -> Query:
    flat: set = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def of_strings(strings: frozenset[str]) -> Query:
    """What a text must hold if it holds one of the strings."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def derive(tree, strings: frozenset[str] = frozenset({""})) -> tuple[frozenset[str] | None, Query]:
    """Of a parsed expression: the exact (lower-cased) strings it matches, where these are few, and what must stand in a
    text besides. Where strings
    become many, or an open-ended part follows, their trigrams are demanded and the strings begin anew."""
    demand: list[Query] = []
    exact: frozenset[str] | None = strings

    def close() -> None:
        nonlocal exact
        if exact is not None:
            demand.append(of_strings(exact))
        exact = frozenset({""})

    whole = True
    for op, arg in tree:
        step: frozenset[str] | None = None
        if op is C.LITERAL:
            step = frozenset({chr(arg).lower()})
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
            step = frozenset(chr(v).lower() for _, v in arg)
        elif op is C.SUBPATTERN:
            step, inner = derive(arg[-1])
            demand.append(inner)
        elif op is C.BRANCH:
            sides = [derive(t) for t in arg[1]]
            if all(s is not None for s, _ in sides):
                step = frozenset().union(*(s for s, _ in sides))
            else:
                demand.append(both("or", [both("and", [q] + ([of_strings(s)] if s is not None else [])) for s, q in sides]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            s, inner = derive(body)
            if low == 0 and high == 1 and s is not None:
                step = s | {""}
            elif low >= 1:
                demand.append(inner)
                if s is not None and low == high and low <= 8 and len(s) == 1:
                    step = frozenset({next(iter(s)) * low})
                elif s is not None:
                    demand.append(of_strings(s))
        elif op is C.AT:
            step = frozenset({""})
        if step is None or len(step) > MANY:
            close()
            whole = False
            continue
        grown = frozenset(a + b for a in exact for b in step)
        if len(grown) > MANY or max(map(len, grown)) > LONG:
            close()
            whole = False
            grown = step
        exact = grown
    if whole:
        return exact, both("and", demand)
    return None, both("and", [*demand, of_strings(exact)])


def trigram_query(regex: str) -> Query:
    strings, query = derive(_parser.parse(regex))
    return query if strings is None else both("and", [query, of_strings(strings)])


def trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


class Postings:
    """For each needed trigram the documents (as a mask) that hold it, from one pass over the trigrams of all texts: every
    position's three bytes are one number, and a table of all such numbers tells which trigram, if any, it is."""

    def __init__(self, texts: Sequence[bytes], table: np.ndarray, needed: Sequence[str]) -> None:
        self.n, k = len(texts), len(needed)
        held = np.zeros((k + 1, self.n), bool)
        lo = 0
        while lo < self.n:
            hi, size = lo, 0
            while hi < self.n and (hi == lo or size + len(texts[hi]) < SLICE):
                size += len(texts[hi]) + 1
                hi += 1
            # 0xFF stands in no text and so in no needed trigram.
            data = np.frombuffer(b"\xff".join(texts[lo:hi]).lower() + b"\xff\xff", np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
            for at in range(0, len(data) - 2, SLICE):
                part = data[at : at + SLICE + 2].astype(np.uint32)
                which = table[part[:-2] | part[1:-1] << 8 | part[2:] << 16]
                place = np.nonzero(which)[0]
                held[which[place], lo + np.searchsorted(ends, place + at, "right")] = True
            lo = hi
        self.of = {g: held[j + 1] for j, g in enumerate(needed)}

    def meet(self, q: Query) -> np.ndarray:
        if q is True:
            return np.ones(self.n, bool)
        if isinstance(q, str):
            return self.of[q] if q in self.of else np.ones(self.n, bool)
        masks = [self.meet(x) for x in q[1]]
        return (np.logical_and if q[0] == "and" else np.logical_or).reduce(masks)


class Scanner:
    def __init__(self, rules: Sequence[SecretRule] = BASE + MORE) -> None:
        self.rules = list(rules)
        self.queries = [trigram_query(r.regex) for r in rules]
        # One with other than ASCII characters is no demand: texts are lower-cased in ASCII only.
        self.needed = sorted(g for g in set().union(*map(trigrams, self.queries)) if g.isascii())
        self.table = np.zeros(1 << 24, np.uint16)
        for j, g in enumerate(self.needed):
            self.table[int.from_bytes(g.encode(), "little")] = j + 1
        self.compiled = [re.compile(r.regex, re.ASCII) for r in rules]
        self.runs = [self.run_of(r, q) for r, q in zip(rules, self.queries, strict=True)]

    @staticmethod
    def run_of(rule: SecretRule, query: Query) -> tuple[bytes, bytes] | None:
        """For a rule that is a run of ASCII characters of one class: a byte table that maps the class to 1, and the run."""
        tree = _parser.parse(rule.regex)
        if query is not True or rule.group or len(tree) != 1 or tree[0][0] is not C.MAX_REPEAT or tree[0][1][1] != C.MAXREPEAT:
            return None
        body = tree[0][1][2]
        if len(body) != 1 or body[0][0] is not C.IN or any(k not in (C.LITERAL, C.RANGE) or (v if k is C.LITERAL else v[1]) > 127 for k, v in body[0][1]):
            return None
        one = re.compile(rule.regex)
        return bytes(1 if b < 128 and one.match(chr(b)) else 0 for b in range(256)), b"\x01" * max(1, rule.least)

    def spans(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        coded = [t.encode("utf-8", "replace") for t in texts]
        postings = Postings(coded, self.table, self.needed)
        for k, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in np.nonzero(postings.meet(query))[0]:
                text = texts[i]
                if self.runs[k] is not None:
                    to_one, run = self.runs[k]
                    if run not in coded[i].translate(to_one):
                        continue
                for m in self.compiled[k].finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for s in out:
            s.sort()
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[SecretRule] = BASE + MORE) -> DataFrame:
    """doc_id and spans (array of kind, start, end in order of start, then kind as listed): one row per document."""
    small_batches(docs.sparkSession)
    kinds = [r.kind for r in rules]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    @F.pandas_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for s in parts:
            yield pd.Series([[{"kind": kinds[k], "start": a, "end": b} for a, k, b in row] for row in scanner.spans(s.tolist())], index=s.index, dtype=object)

    return narrow.select("doc_id", found("text").alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
