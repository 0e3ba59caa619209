"""What is handed to an external tagger and what comes back: blocks with known places, phrases in other wordings, and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators.text import bag_key, terminated

#: A word this long may end otherwise; by so many letters.
LONG_WORD, MOST_SUFFIX = 5, 4


def blocks(records: DataFrame) -> DataFrame:
    """report, segment, start, end, block of records(report, segment, reply): each reply under a marked line, its lines closed,
    placed as it lies in the report's text, which joins the blocks by line ends."""
    b = F.concat(F.lit("sentence_number: "), F.col("segment").cast("string"), F.lit(";\n"), terminated(F.coalesce("reply", F.lit(""))))
    rows = records.select("report", "segment", b.alias("block"))
    w = Window.partitionBy("report").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("block") + 1).over(w), F.lit(0))
    return rows.withColumn("start", at).withColumn("end", F.col("start") + F.length("block"))


def staged(placed: DataFrame) -> DataFrame:
    """report, text: the text that the blocks make."""
    g = placed.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("start", "block"))).alias("b"))
    return g.select("report", F.array_join(F.transform("b", lambda x: x.block), "\n").alias("text"))


def attributed(hits: DataFrame, placed: DataFrame) -> DataFrame:
    """hits(report, id, start, end, phrase) with the segment of the block that holds them, null where none does or the block
    does not read as the phrase there. Blocks of a report don't overlap, so a hit meets one at most."""
    met = hits.join(placed.select("report", "segment", F.col("start").alias("a"), F.col("end").alias("b"), "block"), "report")
    inside = (F.col("a") <= F.col("start")) & (F.col("start") < F.col("b"))
    reads = F.substr("block", (F.col("start") - F.col("a") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("phrase")
    found = met.where(inside & reads).groupBy("report", "id").agg(F.min("segment").alias("segment"))
    return hits.join(found, ["report", "id"], "left")


def linkage(hits: DataFrame) -> DataFrame:
    """report, segment, term, n of attributed hits(report, segment, term, negated): negated and unlinked ones go."""
    return hits.where(~F.col("negated") & F.col("term").isNotNull() & F.col("segment").isNotNull()).groupBy("report", "segment", "term").agg(F.count(F.lit(1)).alias("n"))


def predicted_sets(hits: DataFrame, reports: DataFrame) -> DataFrame:
    """report, terms: the distinct linked terms that are not negated; reports without any have an empty list."""
    s = hits.where(~F.col("negated") & F.col("term").isNotNull()).groupBy("report").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return reports.select("report").distinct().join(s, "report", "left").select("report", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def route_summary(links: DataFrame) -> DataFrame:
    """One row on links(route, term): lines, resolved ones, the share that were a label as they stood, and lines of each route."""
    routes = ("exact", "singular", "bag", "none")
    r = F.coalesce("route", F.lit("none"))
    n = F.count(F.lit(1))
    return links.agg(n.alias("n_lines"), F.count("term").alias("n_resolved"), (F.count_if(r == "exact") / F.greatest(n, F.lit(1))).alias("on_label_rate"), *[F.count_if(r == x).alias(f"n_{x}") for x in routes])


def simplified(words: Column, numbers: dict[str, str], stop: tuple[str, ...]) -> Column:
    """Words with numerals spelled out that have a word, and without stop words and other numbers."""
    known = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    spelled = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))
    named = F.filter(spelled, lambda w: ~w.isin(*stop) & w.try_cast("double").isNull())
    return named


def lemma_key(words: Column, lemmas: dict[str, str]) -> Column:
    """One key for all orders of the words' base forms."""
    known = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv])
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))), " ")


def expanded(spans: DataFrame, whole: DataFrame, single: DataFrame) -> DataFrame:
    """id, variant, how of spans(id, words): whole(key, to) rewrites a span by its bag of words, single(word, to) one word of
    a longer span at a time. Both tables are curated and small; they are met by equi-joins."""
    a = spans.withColumn("key", bag_key(F.array_join("words", " "))).join(whole, "key").select("id", F.col("to").alias("variant"), F.lit("whole").alias("how"))
    each = spans.where(F.size("words") > 1).select("id", "words", F.posexplode("words").alias("i", "word")).join(single, "word")
    b = each.select("id", F.array_join(F.transform("words", lambda w, i: F.when(i == F.col("i"), F.col("to")).otherwise(w)), " ").alias("variant"), F.lit("word").alias("how"))
    return a.unionByName(b).distinct()


def inflected(phrase: Column) -> Column:
    """An expression that finds a phrase with other endings of its long words, its words joined by blanks or hyphens."""
    part = lambda w: F.when((F.length(w) >= LONG_WORD) & w.rlike("^[A-Za-z]+$"), F.concat(F.substr(w, F.lit(1), F.length(w) - 2), F.lit("[a-z]{0,%d}" % MOST_SUFFIX))).otherwise(F.regexp_replace(w, r"([^A-Za-z0-9])", r"\\$1"))  # noqa: E731, UP031
    words = F.filter(F.split(phrase, r"\s+"), lambda w: w != "")
    return F.concat(F.lit(r"\b"), F.array_join(F.transform(words, part), r"[\s\-]+"), F.lit(r"\b"))


def find_phrases(segments: DataFrame, phrases: DataFrame) -> DataFrame:
    """report, segment, term, tier, start: of phrases(report, term, phrase) in segments(report, segment, text) the best place
    of each term in each segment: as written (0) before inflected (1), then the first, without regard to case."""
    met = segments.join(phrases, "report")
    low = F.lower("text")
    plain = F.concat(F.lit(r"\b"), F.regexp_replace(F.lower("phrase"), r"([^A-Za-z0-9\s])", r"\\$1"), F.lit(r"\b"))
    a, b = F.regexp_instr(low, plain), F.regexp_instr(low, inflected(F.lower("phrase")))
    hit = F.when(a > 0, F.struct(F.lit(0).alias("tier"), (a - 1).alias("start"))).when(b > 0, F.struct(F.lit(1).alias("tier"), (b - 1).alias("start")))
    found = met.withColumn("x", hit).where("x is not null")
    return found.groupBy("report", "segment", "term").agg(F.min("x").alias("x")).select("report", "segment", "term", "x.tier", "x.start")


def dispatch(readers: dict[str, Callable[[DataFrame], DataFrame]], normaliser: str, records: DataFrame) -> DataFrame:
    """The records as the named reader links them, with its name."""
    if normaliser not in readers:
        raise KeyError(f"no normaliser {normaliser}; known: {', '.join(sorted(readers))}")
    return readers[normaliser](records).withColumn("normaliser", F.lit(normaliser))
