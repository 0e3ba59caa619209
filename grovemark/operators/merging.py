"""Records of one annotation that several sources carry, folded into one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that a host takes from a folded record where it has none itself.
FIELDS = ("trigger", "segment", "context")
OUT = "report long, code string, host long, n_merged int, ids string, sources string, trigger string, segment long, context string, confirmed boolean, n_claims int"


def has_position(trigger: Column, segment: Column, offset: Column) -> Column:
    return F.coalesce(F.trim(trigger) != "", F.lit(False)) | segment.isNotNull() | offset.isNotNull()


def same_annotation(a: Column, b: Column) -> Column:
    """Two spans (structs or null) are one annotation unless both are somewhere and differ."""
    return a.isNull() | b.isNull() | (a == b)


def known_labels(labels: Column, vocabulary: list[str]) -> Column:
    """The labels that are in the vocabulary, once each, in its order."""
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda v: F.array_contains(F.coalesce(labels, F.array().cast("array<string>")), v))


def current_label(c: Column, aliases: dict[str, str]) -> Column:
    """An old label, alone or before a bar, as the one it became."""
    for old, new in aliases.items():
        c = F.when(c == old, F.lit(new)).when(F.startswith(c, F.lit(f"{old}|")), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(c)
    return c


def merge_identical(records: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """OUT, one row per annotation of records(report, code, id, source, span, trigger, segment, context, confirmed).

    span says where a record sits, null for nowhere. Within a report and code, records that sit somewhere come first, then
    those with a trigger, with a segment, and of the better source. Each joins the first host that does not contradict its
    place, if both sources are ranked; else it becomes a host. A host keeps its own fields and takes those it lacks; claims
    count folded records whose stated trigger or segment differs from the host's at that time. One group is one code of one
    report."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        value = lambda x: None if x is None or pd.isna(x) or (isinstance(x, str) and not x.strip()) else x
        rows = [{k: value(v) for k, v in r.items()} for r in part.to_dict("records")]
        last = len(ranks)
        rows.sort(key=lambda r: (r["span"] is None, r["trigger"] is None, r["segment"] is None, ranks.get(r["source"], last), r["id"]))
        hosts = []
        for r in rows:
            joins = r["source"] in ranks
            host = next((h for h in hosts if joins and h["source"] in ranks and (h["span"] is None or r["span"] is None or h["span"] == r["span"])), None)
            if host is None:
                hosts.append({**r, "ids": [r["id"]], "sources": [r["source"]], "claims": 0})
                continue
            host["ids"].append(r["id"])
            if r["source"] not in host["sources"]:
                host["sources"].append(r["source"])
            host["claims"] += any(r[f] is not None and host[f] is not None and r[f] != host[f] for f in ("trigger", "segment"))
            for f in (*FIELDS, "confirmed"):
                if host[f] is None:
                    host[f] = r[f]
        return pd.DataFrame(
            [[h["report"], h["code"], h["id"], len(h["ids"]), ",".join(str(int(i)) for i in h["ids"]), ",".join(h["sources"]), h["trigger"], h["segment"], h["context"], h["confirmed"], h["claims"]] for h in hosts],
            columns=[c.split()[0] for c in OUT.split(", ")],
        ).astype({"segment": "Int64", "confirmed": "boolean"})

    return records.groupBy("report", "code").applyInPandas(fold, OUT)


def best_location(rows: DataFrame, by: tuple[str, ...], rank: str) -> DataFrame:
    """by, location: of each key's rows(location) the one of least rank, ties to the smallest."""
    return rows.groupBy(*by).agg(F.min(F.struct(rank, "location")).alias("x")).select(*by, "x.location")
