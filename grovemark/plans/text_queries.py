"""Queries on model replies, linking, contamination and token-set clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovemark.operators import linking, text
from grovemark.plans import fixtures as fx
from grovemark.plans.fixtures import sql
from grovemark.plans.registry import query


def _replies(spark, d):
    """Conversation turns with marks of reasoning planted by turn and conversation."""
    t, k = F.coalesce("text", F.lit("")), (F.col("conv_id") + F.col("turn")) % 5
    marked = F.when(k == 0, F.concat(F.lit("<think>"), t, F.lit("</THINK> yes\n"))).when(k == 1, F.concat(t, F.lit("</think> no"))).when(k == 2, F.concat(F.lit("so <think>"), t)).when(k == 3, F.concat(F.lit("<unused94>x</unused95> "), t)).otherwise(t)
    return fx.table(spark, d, "conversations").select("conv_id", "turn", "role", marked.alias("text"))


_RE = r"SELECT conv_id, turn, role, CASE (conv_id + turn) % 5 WHEN 0 THEN '<think>' || t || '</THINK> yes' || chr(10) WHEN 1 THEN t || '</think> no' WHEN 2 THEN 'so <think>' || t WHEN 3 THEN '<unused94>x</unused95> ' || t ELSE t END AS text FROM (SELECT *, coalesce(text, '') AS t FROM conversations)"
_STRIP = "text"
for _p in (r"(?is)<think>.*?</think>", r"(?is)<unused94>.*?</?unused95>", r"(?is)^.*?</think>", r"(?is)<think>.*$", r"(?is)<unused94>.*$"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', ' ', 'g')"
_STRIP = rf"regexp_replace({_STRIP}, '^\s+|\s+$', '', 'g')"


@query("strip_reasoning", "conv_id:i turn:i n:i digest:s", sql(f"SELECT conv_id, turn, length(a) AS n, md5(a) AS digest FROM (SELECT conv_id, turn, {_STRIP} AS a FROM re)", re=_RE))
def _(spark, d):
    return _replies(spark, d).select("conv_id", "turn", text.answer_only(F.col("text")).alias("a")).select("conv_id", "turn", F.length("a").alias("n"), F.md5("a").alias("digest"))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(regexp_replace({0}, '([A-Z])-([0-9])', '\1\2', 'g'))), '[-_\"''\\\t\r\n\x{{2018}}\x{{2019}}]', ' ', 'g'), '\s+'), lambda w: w <> '')"


@query("process_words", "doc_id:i n:i digest:s", sql(f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)"))
def _(spark, d):
    w = fx.table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("echo_rate", "conv_id:i turn:i echo:d", sql(f"SELECT b.conv_id, b.turn, CASE WHEN len(b.w) > 0 THEN CAST(len(list_filter(b.w, lambda x: list_contains(a.w, x))) AS DOUBLE) / len(b.w) ELSE 0 END AS echo FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE b.role = 'assistant'", w=f"SELECT conv_id, turn, role, {_WORDS.format('text')} AS w FROM conversations"))
def _(spark, d):
    w = fx.table(spark, d, "conversations").select("conv_id", "turn", "role", text.words(F.col("text")).alias("w"))
    asked = w.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("source"))
    return w.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select("conv_id", "turn", text.echo_rate(F.col("w"), F.col("source")).alias("echo"))


@query("exact_dup_signature", "doc_id:i signature:s n_tokens:i", sql("SELECT doc_id, substr(sha256(array_to_string(w, ' ')), 1, 16) AS signature, len(list_distinct(w)) AS n_tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)"))
def _(spark, d):
    t = F.col("text")
    return fx.table(spark, d, "documents").select("doc_id", text.signature(t).alias("signature"), F.size(F.array_distinct(text.tokens(t))).alias("n_tokens"))


@query("split_conjuncts", "doc_id:i n:i digest:s", sql(r"SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '[,;]') THEN list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda p: trim(p, ' ' || chr(9) || '.;,')), lambda p: p <> '') ELSE [] END AS p FROM documents)"))
def _(spark, d):
    p = fx.table(spark, d, "documents").select("doc_id", text.conjuncts(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("terminate_lines", "doc_id:i digest:s", sql(r"SELECT doc_id, md5(array_to_string(list_transform(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: CASE WHEN x <> '' AND NOT regexp_matches(x, '[.;:,!?]$') THEN x || ';' ELSE x END), chr(10))) AS digest FROM documents"))
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text.terminated(F.col("text"))).alias("digest"))


_RUNS = "SELECT {0}, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS run FROM (SELECT {0}, list_transform(regexp_extract_all(text, '[a-zA-ZäöüÄÖÜß0-9]+'), lambda x: lower(x)) AS w FROM {1})"


@query("ngram_contamination", "doc_id:i n_runs:i n_items:i", sql("SELECT doc_id, count(DISTINCT d.run) AS n_runs, count(DISTINCT item_id) AS n_items FROM dr d JOIN br b ON d.run = b.run GROUP BY doc_id", dr=_RUNS.format("doc_id", "documents"), br=_RUNS.format("item_id", "benchmark")))
def _(spark, d):
    """Runs of eight words that documents share with benchmark items. The documents' runs are cut down to those of the
    benchmark before anything is grouped."""
    runs = lambda t, k: fx.table(spark, d, t).select(k, F.explode(text.word_runs(F.col("text"), 8)).alias("run"))
    met = runs("documents", "doc_id").join(runs("benchmark", "item_id"), "run")
    return met.groupBy("doc_id").agg(F.countDistinct("run").alias("n_runs"), F.countDistinct("item_id").alias("n_items"))


_J = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents"
_JN = "SELECT doc_id, count(*) AS n FROM j GROUP BY 1"
_JL = "SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM j x JOIN j y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN jn p ON p.doc_id = a JOIN jn q ON q.doc_id = b WHERE c / (p.n + q.n - c) >= 0.8"


@query("near_dup_jaccard", "doc_id:i cluster:i", sql("SELECT doc_id, least(doc_id, (SELECT min(o) FROM reach WHERE n = doc_id)) AS cluster FROM documents", j=_J, jn=_JN, jl=_JL, reach="SELECT a AS n, b AS o FROM jl UNION SELECT reach.n, jl.b FROM reach JOIN jl ON jl.a = reach.o"))
def _(spark, d):
    return linking.token_set_clusters(fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 0.8).withColumnRenamed("id", "doc_id")


def _surfaces(spark, d):
    return fx.table(spark, d, "part").select(fx.part("p_partkey").alias("term"), F.concat_ws(" ", "p_type", "p_name").alias("surface"))


def _mentions(spark, d):
    """Part names in other spellings: capitals and blanks, plural, other order, unknown."""
    k, n, t = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_type")
    m = F.when(k == 0, F.upper(F.concat_ws("  ", t, n))).when(k == 1, F.concat(t, F.lit(" "), n, F.lit("s"))).when(k == 2, F.concat_ws(" ", n, t)).otherwise(F.concat(n, F.lit(" x"), F.col("p_partkey").cast("string")))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), m.alias("mention"))


_SU = "SELECT 'P' || p_partkey AS term, p_type || ' ' || p_name AS surface FROM part"
_ME = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN upper(p_type || '  ' || p_name) WHEN 1 THEN p_type || ' ' || p_name || 's' WHEN 2 THEN p_name || ' ' || p_type ELSE p_name || ' x' || p_partkey END AS mention FROM part"
_KEY = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_ONE = r"CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN {0}[:-4] || 'y' WHEN length({0}) > 4 AND regexp_matches({0}, '(s|x|z|ch|sh)es$') THEN {0}[:-3] WHEN length({0}) > 3 AND {0} LIKE '%s' AND NOT regexp_matches({0}, '(ss|us|is)$') THEN {0}[:-2] ELSE {0} END"
_BAG = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
_IX = f"SELECT {_KEY.format('surface')} AS k, min(term) AS term, count(DISTINCT term) AS n_terms FROM su GROUP BY 1"
_PROBES = f"SELECT id, k, array_to_string(list_transform(w, lambda x: {_ONE.format('x')}), ' ') AS k1, array_to_string(list_append(w[:-2], {_ONE.format('w[-1]')}), ' ') AS k2, {_BAG.format('k')} AS k3 FROM (SELECT id, k, string_split(k, ' ') AS w FROM (SELECT id, {_KEY.format('mention')} AS k FROM me))"


@query("surface_index", "key:s term:s n_terms:i", sql("SELECT k AS key, term, n_terms FROM ix", su=_SU, ix=_IX))
def _(spark, d):
    return linking.surface_index(_surfaces(spark, d))


@query("surface_link", "id:i tier:s term:s",
       sql("SELECT id, CASE WHEN a.term IS NOT NULL THEN 'exact' WHEN coalesce(b.term, c.term) IS NOT NULL THEN 'singular' WHEN e.term IS NOT NULL THEN 'bag' END AS tier, coalesce(a.term, b.term, c.term, e.term) AS term FROM pr LEFT JOIN ix a ON a.k = pr.k LEFT JOIN ix b ON b.k = k1 LEFT JOIN ix c ON c.k = k2 LEFT JOIN bg e ON e.k = k3", su=_SU, me=_ME, ix=_IX, pr=_PROBES, bg=f"SELECT {_BAG.format('k')} AS k, min(term) AS term FROM ix GROUP BY 1"))
def _(spark, d):
    return linking.link(_mentions(spark, d), _surfaces(spark, d))


@query("singular_variants", "id:i variants:s", sql("SELECT id, array_to_string(list_filter(CASE WHEN k1 = k2 THEN [k1] ELSE [k1, k2] END, lambda v: v <> k), '|') AS variants FROM pr", me=_ME, pr=_PROBES))
def _(spark, d):
    m = _mentions(spark, d).select("id", text.surface_key(F.col("mention")).alias("k"))
    return m.select("id", F.array_join(text.singular_variants(F.col("k")), "|").alias("variants"))


@query("term_search_partial", "id:i term:s score:d",
       sql(f"SELECT id, term, score FROM (SELECT id, term, max(m / n) AS score, row_number() OVER (PARTITION BY id ORDER BY max(m / n) DESC, term) AS r FROM (SELECT id, CAST(len(w) AS DOUBLE) AS m, w FROM (SELECT p_partkey AS id, list_distinct(string_split({_KEY.format('p_name')}, ' ')) AS w FROM part)) a JOIN (SELECT DISTINCT term, list_sort(list_distinct(string_split({_KEY.format('surface')}, ' '))) AS s, len(list_distinct(string_split({_KEY.format('surface')}, ' '))) AS n FROM su) b ON n > m AND n <= m + 2 AND list_has_all(s, w) GROUP BY id, term) WHERE r <= 20", su=_SU))
def _(spark, d):
    asked = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("mention"))
    return linking.partial(asked, _surfaces(spark, d))
