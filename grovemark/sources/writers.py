"""Sinks of the annotation formats. Each writes a folder of part files in a committed job, so a failed one leaves no half
result; order is kept by a range sort, not in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a table made for reading may have.
TABLE_ROWS = 10_000


def write_jsonl(results: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """One object per row in the columns' order, nulls written out."""
    (results.orderBy(*order) if order else results).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_prediction_sets(sets: DataFrame, path: str) -> None:
    """sets(report, term), null terms for reports without any: one sorted line per report, its sorted codes joined by ;."""
    cells = sets.groupBy("report").agg(F.array_join(F.array_sort(F.collect_set("term")), ";").alias("codes"))
    cells.orderBy("report").write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def write_csv(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """All cells quoted; lists joined by ; and line ends turned to blanks."""
    flat = []
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        c = F.array_join(c.cast("array<string>"), ";") if f.dataType.typeName() == "array" else c.cast("string")
        flat.append(F.regexp_replace(c, r"[\r\n]+", " ").alias(f.name))
    out = rows.orderBy(*order) if order else rows
    out.select(*flat).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_detections(detections: DataFrame, path: str) -> None:
    write_jsonl(detections.select("report", "segment", "term", "count"), path, ("report", "segment", "term"))


def export_gold(rows: DataFrame, reports: DataFrame, path: str, kept: tuple[str, ...] = ("approved", "kept")) -> None:
    """rows(report, term, status) whose status is kept, every one of reports(report) with a line."""
    good = rows.where(F.col("status").isin(*kept)).select("report", "term")
    write_prediction_sets(reports.select("report").join(good, "report", "left"), path)


def write_folds(folds: DataFrame, path: str) -> None:
    """folds(repetition, outer_fold, inner_fold, report, stratum, role); inner_fold is -1 for the reports that evaluate."""
    inner = F.when(F.col("role") == "eval", F.lit(-1)).otherwise(F.col("inner_fold"))
    write_csv(folds.withColumn("inner_fold", inner), path, ("repetition", "outer_fold", "inner_fold", "report"))


def merge_lines(lines: DataFrame, key: str) -> DataFrame:
    """lines(value) of several shards without exact repeats of a key; key: a field of each line's object, null where it has
    none. Lines are compared by content, so they need no order."""
    k = F.get_json_object("value", f"$.{key}")
    return lines.where(F.trim("value") != "").groupBy("value").agg(F.first(k).alias(key))


def _head(rows: DataFrame, precision: int) -> list[list[str]]:
    found = rows.limit(TABLE_ROWS + 1).collect()
    if len(found) > TABLE_ROWS:
        raise ValueError(f"a table for reading has at most {TABLE_ROWS} rows")
    show = lambda x: "" if x is None else f"{x:.{precision}f}" if isinstance(x, float) else str(x)
    return [list(rows.columns), *[[show(x) for x in r] for r in found]]


def markdown_table(rows: DataFrame, precision: int = 3) -> str:
    head, *body = _head(rows, precision)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, body)])


def latex_table(rows: DataFrame, caption: str, label: str, precision: int = 3) -> str:
    clean = lambda c: "".join("\\" + x if x in "&%$#_{}" else x for x in c)
    head, *body = [" & ".join(map(clean, r)) + r" \\" for r in _head(rows, precision)]
    rule = r"\hline"
    return "\n".join([r"\begin{table}", rf"\caption{{{clean(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", head, rule, *body, r"\end{tabular}", r"\end{table}"])
