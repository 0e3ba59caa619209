"""Expressions on model replies: what a reply holds, which lines and terms it offers, and how well they keep to a layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovemark.operators.text import answer_only, trimmed

# Replies and phrases that decline, words that negate, and the layouts a prompt may ask for.
DECLINED = ("", "no", "none", "na", "n a", "nil", "negative", "no phenotype", "no phenotypes", "no symptoms", "no symptom", "no findings", "findings")
DECLINING = ("no phenotype", "no symptom", "no clinical sign", "no abnormal")
NEGATIONS = ("no", "not", "none", "negative", "non", "never", "few", "lower", "fewer", "less", "barely", "normal")
LAYOUTS = ("plain", "free", "sentence", "two_column", "pipe_first", "json")
ARROW, PIPE = "=>", "|"
JSON_TERM = r"""["']term["']\s*:\s*["']([^"']+)["']"""
LIST_MARK, NUMBERED, PROSE = r"^\s*(?:[-*•]|\d+[.)])\s*", r"^\s*\d+[.)]\s+", r"[.!?;]\s+\S"
MOST_WORDS = 12


def has_reasoning(c: Column) -> Column:
    return F.lower(c).contains("<think>")


def has_boxed(c: Column) -> Column:
    return c.rlike(r"(?i)\\boxed\{[^}]*\}")


def starts_with_yes(c: Column) -> Column:
    return F.startswith(F.lower(trimmed(c)), F.lit("yes"))


def contains_yes(c: Column) -> Column:
    return c.contains("Yes")


def wrote(c: Column) -> Column:
    """Whether a reply names anything: not null, empty, nor one that declines."""
    bare = F.regexp_replace(F.lower(answer_only(c)), "[^a-z0-9/ ]", "")
    bare = trimmed(F.regexp_replace(bare, r"\s+", " "))
    declines = bare.isin(*DECLINED)
    for phrase in DECLINING:
        declines |= bare.contains(phrase)
    return F.coalesce((c != "") & ~declines, F.lit(False))


def output_lines(c: Column) -> Column:
    """The lines of a reply without reasoning, list marks and blank ones."""
    lines = F.transform(F.split(answer_only(F.coalesce(c, F.lit(""))), "\n"), lambda x: trimmed(F.regexp_replace(x, LIST_MARK, "")))
    return F.filter(lines, lambda x: x != "")


def json_terms(line: Column) -> Column:
    """The values of all term fields, whether or not the line is valid JSON."""
    return F.regexp_extract_all(line, F.lit(JSON_TERM), F.lit(1))


def term_candidates(line: Column, layout: Column) -> Column:
    """The parts of a line that should be a term under the layout."""
    at = F.locate(ARROW, line)
    right = F.when(at > 0, F.substr(line, at + len(ARROW))).otherwise(line)
    return F.when(layout == "two_column", F.array(right)).when(layout == "pipe_first", F.array(F.substring_index(line, PIPE, 1))).when(layout == "json", json_terms(line)).otherwise(F.array(line))


def share(of: Column, among: Column) -> Column:
    return F.coalesce(F.try_divide(of.cast("double"), among.cast("double")), F.lit(0.0))


def negation_rate(lines: Column) -> Column:
    """Share of lines, each an array of words, with a word that negates."""
    return share(F.size(F.filter(lines, lambda w: F.arrays_overlap(w, F.array(*map(F.lit, NEGATIONS))))), F.size(lines))


def keeps_layout(raw: Column, parts: Column, counts: Column, layout: Column) -> Column:
    """Whether one line keeps to a list layout. parts: its candidates; counts: their numbers of words."""
    mark = F.when(layout == "pipe_first", raw.contains(PIPE)).when(layout == "two_column", raw.contains(ARROW)).otherwise(F.lit(True))
    return ~raw.rlike(NUMBERED) & mark & ~F.exists(counts, lambda n: n > MOST_WORDS) & ~F.exists(parts, lambda p: p.rlike(PROSE))


def compliance(lines: Column, kept: Column, layout: Column) -> Column:
    """Share of lines that keep to the layout (kept: an array of booleans); prose asks for one line, JSON for a term."""
    some = F.exists(lines, lambda x: F.size(json_terms(x)) > 0)
    return F.when(layout == "free", 1.0).when(layout == "sentence", (F.size(lines) == 1).cast("double")).when(layout == "json", some.cast("double")).otherwise(share(F.size(F.filter(kept, lambda k: k)), F.size(lines)))
