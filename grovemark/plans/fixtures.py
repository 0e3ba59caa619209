"""Inputs of the operators, derived from the driver's tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemark.operators import graph

_CLOSED: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(c: str) -> F.Column:
    return F.concat(F.lit("P"), F.col(c).cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    ends = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    leaves = ends.select(part("l_partkey").alias("child"), F.explode(F.array(name("S", F.col("a")), name("S", F.col("b")))).alias("parent"))
    middle = table(spark, d, "supplier").select(name("S", F.col("s_suppkey")).alias("child"), name("N", F.col("s_nationkey")).alias("parent"))
    top = table(spark, d, "nation").select(name("N", F.col("n_nationkey")).alias("child"), name("R", F.col("n_regionkey")).alias("parent"))
    return leaves.union(middle).union(top).distinct()


def closed(spark: SparkSession, d: str) -> DataFrame:
    """The closure table, built once per session and folder, as it is meant to be kept."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CLOSED:
        _CLOSED[key] = graph.closure(edges(spark, d))
    return _CLOSED[key]


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("report"), part("l_partkey").alias("term")).distinct()


def pred(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity >= 25")
    return rows.groupBy(F.col("l_orderkey").alias("report"), part("l_partkey").alias("term")).agg((F.max("l_quantity") / 50).alias("score"))


def pred_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount >= 0.05").select(F.col("l_orderkey").alias("report"), part("l_partkey").alias("term")).distinct()


def pred_x(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in which some ids do not exist and some are above the scorable level."""
    li = table(spark, d, "lineitem").where("l_quantity >= 25")
    term = F.when(F.col("l_partkey") % 97 == 0, F.concat(F.lit("X"), F.col("l_partkey").cast("string"))).when(F.col("l_partkey") % 89 == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).otherwise(part("l_partkey"))
    return li.select(F.col("l_orderkey").alias("report"), term.alias("term")).distinct()


def reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("report"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 8).alias("juror"), (F.col("l_orderkey") % 500).alias("report"), F.col("l_linenumber").alias("segment"), (F.col("l_partkey") % 40).alias("term")).distinct()


def gold_d(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity < 10")
    return li.select((F.col("l_orderkey") % 500).alias("report"), (F.col("l_partkey") % 40).alias("term")).distinct()


def small_tree(spark: SparkSession, d: str) -> DataFrame:
    """Closure of the jurors' 40 terms: t, its tens group (100 + t div 10), and 200."""
    t = spark.range(40).select(F.col("id").alias("t"))
    return t.select(F.col("t").alias("descendant"), F.explode(F.array(F.col("t"), 100 + F.floor(F.col("t") / 10), F.lit(200).cast("long"))).alias("ancestor"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """report, term, rank, margin: scored segments."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("report"), part("l_partkey").alias("term"), "l_extendedprice", "l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) / 5).alias("margin"))
    rank = F.row_number().over(Window.partitionBy("report", "term").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return li.select("report", "term", rank.alias("rank"), "margin")


def sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("conf"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_linestatus").alias("grp"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").alias("term"))


#: The same as SQL.
CTES = {
    "edges": """SELECT DISTINCT child, parent FROM (SELECT 'P' || l_partkey AS child, 'S' || min(l_suppkey) AS parent FROM lineitem GROUP BY l_partkey
      UNION ALL SELECT 'P' || l_partkey, 'S' || max(l_suppkey) FROM lineitem GROUP BY l_partkey
      UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)""",
    "nodes": "SELECT child AS term FROM edges UNION SELECT parent FROM edges",
    "paths": "SELECT term AS descendant, term AS ancestor, 0 AS hops FROM nodes UNION SELECT descendant, parent, hops + 1 FROM paths JOIN edges ON ancestor = child",
    "closed": "SELECT descendant, ancestor, min(hops) AS hops FROM paths GROUP BY ALL",
    "depth": "SELECT descendant AS term, min(hops) + 1 AS depth FROM closed WHERE ancestor LIKE 'R%' GROUP BY 1",
    "long_depth": "SELECT descendant AS term, max(hops) + 1 AS depth FROM paths WHERE ancestor LIKE 'R%' GROUP BY 1",
    "gold": "SELECT DISTINCT l_orderkey AS report, 'P' || l_partkey AS term FROM lineitem WHERE l_returnflag = 'R'",
    "pred": "SELECT l_orderkey AS report, 'P' || l_partkey AS term, max(l_quantity) / 50 AS score FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL",
    "pred_b": "SELECT DISTINCT l_orderkey AS report, 'P' || l_partkey AS term FROM lineitem WHERE l_discount >= 0.05",
    "pred_x": """SELECT DISTINCT l_orderkey AS report, CASE WHEN l_partkey % 97 = 0 THEN 'X' || l_partkey WHEN l_partkey % 89 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS term
      FROM lineitem WHERE l_quantity >= 25""",
    "reports": "SELECT o_orderkey AS report FROM orders",
    "detections": "SELECT DISTINCT l_suppkey % 8 AS juror, l_orderkey % 500 AS report, l_linenumber AS segment, l_partkey % 40 AS term FROM lineitem",
    "gold_d": "SELECT DISTINCT l_orderkey % 500 AS report, l_partkey % 40 AS term FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10",
    "tree_d": "SELECT t AS descendant, unnest([t, 100 + t // 10, 200]) AS ancestor FROM range(40) x(t)",
    "calls": """SELECT l_orderkey % 200 AS report, 'P' || l_partkey AS term, row_number() OVER (PARTITION BY l_orderkey % 200, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank,
      (l_quantity - 25) / 5 AS margin FROM lineitem""",
    "sample": "SELECT l_quantity / 50 AS conf, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus AS grp FROM lineitem",
    "vectors": "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label AS term FROM embeddings",
    "pairs": """SELECT coalesce(g.report, p.report) AS report, coalesce(g.term, p.term) AS term, CASE WHEN g.term IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN p.term IS NULL THEN 0 ELSE 1 END AS p
      FROM gold g FULL JOIN pred p ON g.report = p.report AND g.term = p.term""",
    "units": "SELECT report, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM pairs GROUP BY report",
    "masks": "SELECT report, term, bit_or(CAST(1 AS BIGINT) << CAST(juror AS BIGINT)) AS mask FROM detections GROUP BY ALL",
    "hist": """SELECT mask, count(*) AS n_terms, count(g.term) AS n_gold FROM masks m LEFT JOIN gold_d g ON m.report = g.report AND m.term = g.term GROUP BY mask""",
}
NEEDS = {
    "nodes": ["edges"], "paths": ["nodes"], "closed": ["paths"], "depth": ["closed"], "long_depth": ["paths"], "pairs": ["gold", "pred"],
    "units": ["pairs"], "masks": ["detections"], "hist": ["masks", "gold_d"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """A statement over the named inputs, in order of need; extra: further ones of its own."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


def div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, str]:
    return {"precision": div(tp, f"({tp} + {fp})"), "recall": div(tp, f"({tp} + {fn})"), "f1": div(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})")}
