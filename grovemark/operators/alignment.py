"""Where the pieces of a report stand in it: segments, triggers, repairs of damaged text, and tables.

Work that depends on what was found before runs over one report at a time in Arrow batches; the rest is column expressions.
Blanks are the ASCII ones.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemark.operators.quality import ratio

BLANKS = re.compile(r"[ \t\n\r\f\v]+")
#: How far from its stated place a trigger is looked for.
NEAR = 400

# What damaged text looks like and how it should read. A unit that could be two is only marked.
REPAIRS = ((r"(?<=[a-z])rn(?=ia\b|ic\b|al\b)", "m"), (r"\bgmol\b", "µmol"), (r"(?i)\bum0?1\b", "µmol"), (r"\bumol\b", "µmol"), (r"\bpmo1\b", "pmol"))
AMBIGUOUS = r"(?i)\bmol\s*/\s*mol(?:\s+creat\w*)?"
VALUE, CELL = r"[<>]?\s*\d+(?:[.,]\d+)?(?:\s*-\s*\d+(?:[.,]\d+)?)?", r"\s{2,}|\t"


def normal(c: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", ""))


def _indexed(text: str) -> tuple[str, list[int]]:
    """The normal form and for each of its characters the place in the text."""
    out, at, pending = [], [], False
    for i, ch in enumerate(text):
        if ch in " \t\n\r\f\v":
            pending = bool(out)
            continue
        if pending:
            out.append(" ")
            at.append(i)
            pending = False
        for low in ch.lower():
            out.append(low)
            at.append(i)
    return "".join(out), at


def align_one(text: str | None, segments: list[str | None]) -> list[tuple[int | None, int | None, int | None]]:
    """For each segment its start and end in the text and its start in the normal form: searched from where the last one
    ended, else from the top without going back; null where it stands nowhere."""
    whole, at = _indexed(text or "")
    out, cursor = [], 0
    for s in segments:
        needle = BLANKS.sub(" ", s or "").strip(" ").lower()
        k = whole.find(needle, cursor) if needle else -1
        if needle and k < 0:
            k = whole.find(needle)
        if k < 0:
            out.append((None, None, None))
            continue
        out.append((at[k], at[k + len(needle) - 1] + 1, k))
        cursor = max(cursor, k + len(needle))
    return out


def align(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """report, segment_idx, start, end, at, segment of segments(report, segment_idx, segment) in texts(report, text): the
    half-open range in the text, and where the normal form begins. A report's segments meet in one array with its text."""
    gathered = segments.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("segment_idx", "segment"))).alias("s")).join(texts, "report", "left")

    @F.pandas_udf("array<struct<start: bigint, end: bigint, at: bigint>>")
    def found(text: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "at": c} for a, b, c in align_one(t, [p["segment"] for p in s])] for t, s in zip(text, parts, strict=True)], dtype=object)

    plain = gathered.withColumn("r", found("text", "s"))
    out = plain.select("report", F.explode(F.arrays_zip("s", "r")).alias("x"))
    return out.select("report", "x.s.segment_idx", "x.r.start", "x.r.end", "x.r.at", "x.s.segment")


def alignment_stats(aligned: DataFrame, *by: str) -> DataFrame:
    return aligned.groupBy(*by).agg(F.count(F.lit(1)).alias("n_segments"), F.count("start").alias("n_aligned"), F.count_if(F.col("start").isNull()).alias("n_unaligned"))


def segment_texts(aligned: DataFrame, texts: DataFrame) -> DataFrame:
    """report, segment_idx, shown: the segment as the text spells it, its own string where it was not found."""
    cut = F.substr("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return aligned.join(texts, "report", "left").select("report", "segment_idx", F.when(F.col("start").isNotNull(), cut).otherwise(F.col("segment")).alias("shown"))


def in_ranges(points: DataFrame, ranges: DataFrame, point: str, key: str) -> DataFrame:
    """points with the key of the first range(report, start, end) that holds the point, -1 for none; a join within reports."""
    held = points.select("report", "id", point).join(ranges.select("report", F.col(key).alias("__k"), "start", "end"), "report").where((F.col("start") <= F.col(point)) & (F.col(point) < F.col("end")))
    first = held.groupBy("report", "id").agg(F.min("__k").alias(key))
    return points.join(first, ["report", "id"], "left").withColumn(key, F.coalesce(key, F.lit(-1)))


def offsets_hold(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """spans(report, start, end, text) with ok: is the range inside the report's text and does it read as the span's text."""
    met = spans.join(texts.select("report", F.col("text").alias("__t")), "report", "left")
    cut = F.substr("__t", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    inside = (F.col("start") >= 0) & (F.col("end") <= F.length("__t")) & (F.col("start") < F.col("end"))
    return met.withColumn("ok", F.coalesce(inside & (cut == F.col("text")), F.lit(False))).drop("__t")


def trigger_pattern(trigger: Column) -> Column:
    """An expression that finds a trigger with any run of blanks where it has one, without regard to case."""
    literal = F.regexp_replace(F.regexp_replace(trigger, r"^\s+|\s+$", ""), r"([^A-Za-z0-9\s])", r"\\$1")
    return F.concat(F.lit("(?i)"), F.regexp_replace(literal, r"\s+", r"\\s+"))


def find_trigger(text: Column, trigger: Column) -> Column:
    """start, end of the first occurrence that word ends bound, else of any; null without one or without a trigger."""
    bare = F.regexp_replace(trigger, r"^\s+|\s+$", "")
    p = trigger_pattern(trigger)
    bounded = F.concat(F.lit("(?i)\\b"), F.substr(p, F.lit(5)), F.lit("\\b"))
    chosen = F.when(F.regexp_instr(text, bounded) > 0, bounded).otherwise(p)
    at = F.regexp_instr(text, chosen)
    found = F.regexp_substr(text, chosen)
    return F.when((F.length(bare) > 0) & (at > 0), F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(found)).cast("long").alias("end")))


def resolve_offset(text: Column, offset: Column, trigger: Column, near: int = NEAR) -> Column:
    """The offset if the trigger stands there, else where it stands within near characters, else null."""
    here = F.lower(F.substr(text, offset.cast("int") + 1, F.length(trigger))) == F.lower(trigger)
    low = F.greatest(F.lit(0), offset - near)
    window = F.substr(text, low.cast("int") + 1, (offset + near - low + F.length(trigger)).cast("int"))
    return F.when(here, offset).otherwise(low + find_trigger(window, trigger)["start"])


def _matches(pattern: str, suggested: str | None):
    """All matches of a pattern with their places, which no built-in function gives."""
    compiled = re.compile(pattern)

    @F.pandas_udf("array<struct<start: bigint, end: bigint, observed: string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": m.start(), "end": m.end(), "observed": m.group()} for m in compiled.finditer(t or "")] for t in texts], dtype=object)

    return lambda c: F.transform(found(c), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.observed.alias("observed"), F.lit(suggested).cast("string").alias("suggested")))


def repairs(texts: DataFrame) -> DataFrame:
    """report, start, end, observed, suggested, kind, ambiguous: damaged words and units, and units that could be two."""
    found = F.flatten(F.array(*[_matches(p, s)(F.col("text")) for p, s in (*REPAIRS, (AMBIGUOUS, None))]))
    x = texts.select("report", F.explode(found).alias("x")).select("report", "x.*")
    unit = F.col("suggested").isNull() | F.col("suggested").endswith("mol")
    return x.withColumns({"kind": F.when(unit, "unit").otherwise("ocr"), "ambiguous": F.col("suggested").isNull()})


def tables(texts: DataFrame) -> DataFrame:
    """report, line, kind, labels, values, aligned: rows that hold labels and values (inline), and rows of values under a row
    of labels (block). Labels and values of unequal number are marked, never paired."""
    lines = texts.select("report", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    cells = F.filter(F.transform(F.split("s", CELL), lambda c: F.trim(c)), lambda c: c != "")
    value = lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(f"^(?:{VALUE})$")
    rows = lines.withColumn("cells", cells).select("report", "line", F.size("cells").alias("n"), F.filter("cells", value).alias("values"), F.filter("cells", lambda c: ~value(c)).alias("labels"))
    some = lambda c: F.size(c) > 0
    kind = F.when(F.col("n") < 2, "other").when(some("values") & some("labels"), "inline").when(some("labels"), "header").otherwise("values")
    from pyspark.sql.window import Window

    # The last line that is no row of values decides: below a header such rows make a block.
    upto = Window.partitionBy("report").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("kind", kind)
    before = F.last(F.when(F.col("kind") != "values", F.struct("kind", "labels", "line")), ignorenulls=True).over(upto)
    met = rows.withColumn("h", before)
    inline = met.where("kind = 'inline'").select("report", "line", "kind", "labels", "values", ((F.size("labels") == F.size("values")) | (F.size("values") == 1)).alias("aligned"))
    block = met.where("kind = 'values' and h.kind = 'header'").select("report", "line", F.lit("block").alias("kind"), F.col("h.labels").alias("labels"), "values", (F.size("h.labels") == F.size("values")).alias("aligned"))
    return inline.unionByName(block)


def match_to_segments(notes: DataFrame, segments: DataFrame, fuzzy: float = 0.5) -> DataFrame:
    """report, id, segment_idx, tier of notes(report, id, context): exact, then without regard to case, then either within the
    other, then the greatest share of common words if that is at least fuzzy; of equal ones the first segment. A join of a
    report's notes with its segments."""
    met = notes.join(segments.select("report", "segment_idx", "segment"), "report")
    a, b = normal(F.col("context")), normal(F.col("segment"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    share = ratio(F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b))))
    tier = F.when(F.col("context") == F.col("segment"), 1).when(F.lower("context") == F.lower("segment"), 2).when((b != "") & (a.contains(b) | b.contains(a)), 3).when(share >= fuzzy, 4)
    best = met.where(a != "").withColumn("tier", tier).where("tier is not null").groupBy("report", "id").agg(F.min(F.struct("tier", F.when(F.col("tier") == 4, -F.round(share, 12)).otherwise(0.0).alias("o"), "segment_idx")).alias("x"))
    return notes.select("report", "id").join(best, ["report", "id"], "left").select("report", "id", "x.segment_idx", "x.tier")


def shared_runs(payload: DataFrame, texts: DataFrame, n: int = 5) -> DataFrame:
    """Runs of n words that the payload shares with any text; expected to be none."""
    from grovemark.operators.text import word_runs

    runs = lambda d: d.select(F.explode(word_runs(F.col("text"), n)).alias("run")).distinct()
    return runs(payload).join(runs(texts), "run", "left_semi")
