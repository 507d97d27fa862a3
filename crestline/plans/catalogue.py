"""The registered queries of the engine and, where SQL can say them, the same in DuckDB's SQL.

Doubles are rounded to six places on both sides: engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import config
from crestline.functions import cleaning
from crestline.operators import evaluation, models, network, prototype, sentiment, temporal, units
from crestline.plans import bindings as b
from crestline.plans import studies
from crestline.sources.posts import read_events, with_previous

R = b.RULES
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _queries[name] = f
    if sql is not None:
        _sql[name] = sql


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    # adding 0 makes a negative zero a positive one
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- shared parts of the SQL

POSTS = f"""posts AS (SELECT event_id, CAST(user_id AS VARCHAR) AS topic, CAST(user_id % {config.TRENDING_EVERY} = 0 AS INT) AS label,
  CAST(floor((epoch(ts) - epoch(TIMESTAMP '{config.EVENTS_START}')) / {config.EVENTS_BIN_SECONDS}) AS INT) AS bin, event_type AS lang,
  json_extract_string(props, '$.k') AS author, ts FROM events),
first_posts AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY event_id, topic ORDER BY ts) = 1)"""
COUNTS = f"""{POSTS},
counts AS (SELECT topic, label, bin, count(*) AS n_all, count(*) FILTER (lang = '{b.LANG}') AS n_feat FROM first_posts WHERE bin BETWEEN 0 AND {R.n_bins - 1} GROUP BY ALL)"""
DENSE = f"""{COUNTS},
dense AS (SELECT t.topic, t.label, g.bin, coalesce(c.n_all, 0) AS n_all, coalesce(c.n_feat, 0) AS n_feat
  FROM (SELECT DISTINCT topic, label FROM counts) t CROSS JOIN (SELECT CAST(unnest(range(0, {R.n_bins})) AS INT) AS bin) g
  LEFT JOIN counts c ON c.topic = t.topic AND c.bin = g.bin)"""
SMOOTH = f"""{DENSE},
smooth AS (SELECT *, coalesce(lag(n_all) OVER w, n_all) + n_all + coalesce(lead(n_all) OVER w, n_all) AS s FROM dense WINDOW w AS (PARTITION BY topic ORDER BY bin))"""
PEAKS = f"""{SMOOTH},
peaks AS (SELECT topic, label, bin AS peak_bin, s AS peak FROM smooth QUALIFY row_number() OVER (PARTITION BY topic ORDER BY s DESC, bin) = 1)"""


def verdict_sql(min_topic: str = str(R.min_topic), lead: str = str(R.lead), window: str = str(R.window), column: str = "n_feat") -> str:
    """The ladder over sums that ``sums_sql`` made."""
    return f"""CASE WHEN total < {min_topic} THEN 'too_small'
    WHEN peak > 0 AND 100 * first_s >= {R.left_percent} * peak THEN 'left_censored'
    WHEN peak_bin > {R.n_bins - 1 - R.tail} THEN 'right_censored_no_tail'
    WHEN peak > 0 AND 100 * tail >= {R.decay_percent * R.tail} * peak THEN 'right_censored_no_decay'
    WHEN peak_bin - {lead} - {window} < 0 THEN 'window_before_band_start'
    WHEN {column} < {R.min_window} THEN 'window_too_sparse' ELSE 'kept' END"""


SUMS = f"""{PEAKS},
sums AS (SELECT p.topic, p.label, p.peak_bin, p.peak, sum(m.n_all) AS total, max(m.s) FILTER (m.bin = 0) AS first_s,
    coalesce(sum(m.s) FILTER (m.bin BETWEEN p.peak_bin + 1 AND p.peak_bin + {R.tail}), 0) AS tail,
    coalesce(sum(m.n_all) FILTER (m.bin >= p.peak_bin - {R.lead + R.window} AND m.bin < p.peak_bin - {R.lead}), 0) AS n_all,
    coalesce(sum(m.n_feat) FILTER (m.bin >= p.peak_bin - {R.lead + R.window} AND m.bin < p.peak_bin - {R.lead}), 0) AS n_feat
  FROM peaks p JOIN smooth m ON m.topic = p.topic GROUP BY ALL)"""
JUDGED = f"""{SUMS}, judged AS (SELECT *, {verdict_sql()} AS reason FROM sums)"""
UNITS = f"""{JUDGED}, units AS (SELECT topic, label, CAST(total AS BIGINT) AS total_band_tweets, peak_bin, round_even(peak / 3.0, 3) AS peak_height_smoothed,
    peak_bin - {R.lead + R.window} AS window_start_bin, peak_bin - {R.lead} AS window_end_bin, CAST(n_feat AS BIGINT) AS n_window_tweets, CAST(n_all AS BIGINT) AS n_window_tweets_all_langs,
    CASE WHEN n_all = 0 THEN 0.0 ELSE round_even(n_feat / n_all, 4) END AS feature_language_frac FROM judged WHERE reason = 'kept')"""
WPOSTS = f"""{UNITS},
aimed AS (SELECT *, lag(author) OVER (PARTITION BY topic ORDER BY ts, event_id) AS before FROM posts),
wposts AS (SELECT a.event_id, a.topic, a.bin, a.author, a.ts, CASE WHEN a.before <> a.author THEN a.before END AS target, u.window_start_bin, u.window_end_bin
  FROM aimed a JOIN units u ON u.topic = a.topic WHERE a.lang = '{b.LANG}' AND a.bin >= u.window_start_bin AND a.bin < u.window_end_bin
  QUALIFY row_number() OVER (PARTITION BY a.event_id, a.topic ORDER BY a.ts) = 1)"""
GRAPH = f"""{WPOSTS},
edges AS (SELECT topic, author AS src, target AS dst, count(*) AS w FROM wposts WHERE target IS NOT NULL AND author IS NOT NULL GROUP BY ALL),
verts AS (SELECT topic, author AS v FROM wposts WHERE author IS NOT NULL UNION SELECT topic, target FROM wposts WHERE target IS NOT NULL AND author IS NOT NULL),
und AS (SELECT DISTINCT topic, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
sizes AS (SELECT topic, count(*) AS n FROM verts GROUP BY topic)"""
SHAPE = f"""{UNITS},
win AS (SELECT u.topic, u.label, d.bin - u.window_start_bin AS t, CAST(d.n_feat AS DOUBLE) AS x FROM units u JOIN dense d ON d.topic = u.topic AND d.bin >= u.window_start_bin AND d.bin < u.window_end_bin),
lv AS (SELECT topic, sum(x) AS total, avg(x) AS mean FROM win GROUP BY topic),
z AS (SELECT w.topic, w.t, w.x, l.total, l.mean, w.x / l.mean AS z, w.x / l.total AS p, lead(w.x) OVER o AS nx, row_number() OVER (PARTITION BY w.topic ORDER BY w.x, w.t) AS r FROM win w JOIN lv l USING (topic) WHERE l.total > 0 WINDOW o AS (PARTITION BY w.topic ORDER BY w.t)),
q AS (SELECT *, t * t - (SELECT regr_intercept(k * k, k) + 0 FROM range(0, {R.window}) g(k)) - (SELECT regr_slope(k * k, k) FROM range(0, {R.window}) g(k)) * t AS q FROM z),
shape AS (SELECT topic, regr_slope(z, t) AS slope_norm, sum(z * q) / sum(q * q) AS accel_norm, stddev_pop(x) / max(mean) AS burstiness, max(x) / max(mean) AS peakedness,
  -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln({R.window}) AS bin_entropy, 2 * sum(r * x) / ({R.window} * max(total)) - ({R.window} + 1.0) / {R.window} AS bin_gini,
  sum(t * p) / ({R.window} - 1) AS mass_centroid, sum(p) FILTER (t >= {R.window - max(R.window // 4, 1)}) AS frac_last_quarter,
  ln((avg(x) FILTER (t >= {R.window // 2}) + 1e-9) / (avg(x) FILTER (t < {R.window // 2}) + 1e-9)) AS log_half_ratio,
  sum(CASE WHEN nx > x THEN 1.0 ELSE 0 END) / ({R.window} - 1) AS monotone_up_frac, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END) AS zero_bin_frac,
  CASE WHEN sum((z - 1) * (z - 1)) > 1e-9 THEN sum((z - 1) * (nx / mean - 1)) / sum((z - 1) * (z - 1)) ELSE 0 END AS acf1 FROM q GROUP BY topic)"""
VOLUME = """volume AS (SELECT topic, count(*) AS window_tweets, count(DISTINCT author) AS unique_users, count(*) / CAST(count(DISTINCT author) AS DOUBLE) AS tweets_per_user,
  count(*) / CAST(max(bin) - min(bin) + 1 AS DOUBLE) AS tweets_per_active_bin, count(DISTINCT bin) / CAST(max(bin) - min(bin) + 1 AS DOUBLE) AS active_bin_frac FROM wposts GROUP BY topic)"""
DEGREE = """ind AS (SELECT topic, max(d) AS max_in, sum(d) AS m FROM (SELECT topic, dst, count(*) AS d FROM edges GROUP BY ALL) GROUP BY topic),
outd AS (SELECT topic, max(d) AS max_out FROM (SELECT topic, src, count(*) AS d FROM edges GROUP BY ALL) GROUP BY topic),
np AS (SELECT topic, count(*) AS n_posts FROM wposts GROUP BY topic),
deg AS (SELECT s.topic, s.n AS n_nodes, CAST(coalesce(m, 0) AS BIGINT) AS n_edges, CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1.0)) ELSE 0 END AS density, coalesce(m, 0) / CAST(n_posts AS DOUBLE) AS edges_per_tweet,
  CASE WHEN n >= 2 THEN CAST(coalesce(max_in, 0) AS DOUBLE) ELSE 0 END AS max_in_degree, CASE WHEN n >= 2 THEN coalesce(m, 0) / CAST(n AS DOUBLE) ELSE 0 END AS mean_in_degree,
  CASE WHEN n >= 2 THEN CAST(coalesce(max_out, 0) AS DOUBLE) ELSE 0 END AS max_out_degree FROM sizes s JOIN np USING (topic) LEFT JOIN ind USING (topic) LEFT JOIN outd USING (topic))"""
SCORES = """scores AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS key, CAST(l_returnflag = 'R' AS INT) AS label, arm, p FROM lineitem,
  LATERAL (SELECT 'discount' AS arm, round(l_discount * 10, 6) AS p UNION ALL SELECT 'tax', round(l_tax * 12.5, 6)))"""
CURVE = f"""{SCORES},
byp AS (SELECT arm, p, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY arm) AS n_pos, sum(neg) OVER (PARTITION BY arm) AS n_neg FROM byp WINDOW w AS (PARTITION BY arm ORDER BY p DESC))"""
SHAPES = ", ".join(f"round({c}, 6) AS {c}" for c in temporal.SHAPE)
MATRIX = f"""{GRAPH}, {SHAPE.split("win AS", 1)[0].replace(UNITS, "").strip().strip(",")} win AS {SHAPE.split("win AS", 1)[1]}, {VOLUME}, {DEGREE},
feats AS (SELECT * FROM (SELECT topic, label FROM units) JOIN volume USING (topic) JOIN deg USING (topic) JOIN shape USING (topic)),
long AS (UNPIVOT (SELECT topic, label, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in b.SQL_FEATURES)} FROM feats) ON {", ".join(b.SQL_FEATURES)} INTO NAME feature VALUE value)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features rounded alike on both sides, so that ranks agree."""
    return evaluation.stacked(rounded(b.features(spark, sf_dir)), b.SQL_FEATURES)


# --- cleaning

def _raw_names(spark, sf):
    brand = F.col("p_brand")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("  #"), brand)).when(F.col("p_partkey") % 4 == 1, F.concat(brand, F.lit(".CSV "))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("##"), brand, F.lit(".csv"))).otherwise(brand)
    return b.table(spark, sf, "part").select("p_partkey", raw.alias("raw"))


_RAW = "raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  #' || p_brand WHEN 1 THEN p_brand || '.CSV ' WHEN 2 THEN '##' || p_brand || '.csv' ELSE p_brand END AS raw FROM part)"
_CLEAN = r"lower(trim(regexp_replace(regexp_replace(trim({}), '\.csv$', '', 'i'), '^#+', '')))"
_register("clean_topic", lambda s, d: _raw_names(s, d).select("p_partkey", cleaning.clean_topic(F.col("raw")).alias("topic")), f"WITH {_RAW} SELECT p_partkey, {_CLEAN.format('raw')} AS topic FROM raw")


def _printed(spark, sf):
    cell = F.when(F.col("p_partkey") % 5 == 0, "[]").when(F.col("p_partkey") % 5 == 1, "not a list").when(F.col("p_partkey") % 5 == 2, None).otherwise(F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '#"), F.col("p_type"), F.lit("', '']")))
    return b.table(spark, sf, "part").select("p_partkey", cell.alias("cell"))


_register("parse_tags", lambda s, d: _printed(s, d).select("p_partkey", F.array_join(cleaning.parse_tags(F.col("cell")), ",").alias("tags")), "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN '' ELSE lower(p_brand) || ',' || lower(p_type) END AS tags FROM part")


def _names(spark, sf):
    who = lambda c: F.concat(F.lit("{'screen_name': '"), F.col(c), F.lit("', 'name': \"O'x\", 'id': None}"))
    cell = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("["), who("c_name"), F.lit(", "), who("c_mktsegment"), F.lit("]"))).when(F.col("c_custkey") % 3 == 1, "[{'name': 'x'}]").otherwise("[")
    return b.table(spark, sf, "customer").select("c_custkey", F.array_join(cleaning.parse_screen_names(cell), ",").alias("names"))


_register("parse_screen_names", _names, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) || ',' || lower(c_mktsegment) ELSE '' END AS names FROM customer")
_BAND = config.Band("2024-01-02", 6, 21, 15)


def _clocks(spark, sf):
    at = cleaning.bin_of(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), _BAND)
    return b.table(spark, sf, "events").select("event_id", at.alias("bin")).withColumn("clock", cleaning.bin_to_clock(F.col("bin"), _BAND))


_register("bin_of_clock", _clocks, """WITH e AS (SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-02' AND hour(ts) BETWEEN 6 AND 21 THEN CAST((hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT) - 21600) // 900 AS INT) END AS bin FROM events)
SELECT event_id, bin, CASE WHEN bin IS NOT NULL THEN printf('%02d:%02d', CAST(6 + bin // 4 AS INT), CAST(bin % 4 * 15 AS INT)) END AS clock FROM e""")

# --- series and units


def _dedup(spark, sf):
    """Every post and a copy of it an hour later, whose author is another: the first of the two stays."""
    posts = read_events(spark, sf)
    later = posts.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumn("author", F.concat(F.lit("late "), "author"))
    seconds = F.sum(F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.to_timestamp(F.lit(config.EVENTS_START))))
    return units.dedup_posts(later.unionByName(posts)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), seconds.alias("seconds"), F.min("author").alias("first_author"), F.count_if(F.startswith("author", F.lit("late"))).alias("late"))


_register("dedup_id_topic", _dedup, f"""WITH {POSTS}, twice AS (SELECT event_id, topic, ts, author FROM posts UNION ALL SELECT event_id, topic, ts + INTERVAL 1 HOUR, 'late ' || author FROM posts),
firsts AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY event_id, topic ORDER BY ts) = 1)
SELECT topic, count(*) AS n, CAST(sum(floor(epoch(ts)) - epoch(TIMESTAMP '{config.EVENTS_START}')) AS BIGINT) AS seconds, min(author) AS first_author, count(*) FILTER (author LIKE 'late%') AS late FROM firsts GROUP BY topic""")
_register("topic_bin_counts", b.counts, f"WITH {COUNTS} SELECT * FROM counts")
_register("dense_series", lambda s, d: b.series(s, d).select("topic", "label", F.posexplode(F.arrays_zip("x", "f")).alias("bin", "e")).select("topic", "label", "bin", F.col("e.x").alias("n_all"), F.col("e.f").alias("n_feat")), f"WITH {DENSE} SELECT * FROM dense")
_register("smoothed_series", lambda s, d: units.with_peaks(b.series(s, d), R).select("topic", F.posexplode("s").alias("bin", "s")), f"WITH {SMOOTH} SELECT topic, bin, s FROM smooth")
_register("peaks", lambda s, d: units.with_peaks(b.series(s, d), R).select("topic", "label", "peak_bin", "peak"), f"WITH {PEAKS} SELECT * FROM peaks")
_register("verdicts", lambda s, d: b.judged(s, d).select("topic", "label", "reason"), f"WITH {JUDGED} SELECT topic, label, reason FROM judged")
_register("units", b.kept, f"WITH {UNITS} SELECT * FROM units")
_REASON_ROWS = ", ".join(f"({i}, '{r}')" for i, r in enumerate(units.REASONS))
_register("attrition", lambda s, d: units.attrition(b.judged(s, d)), f"""WITH {JUDGED}, steps(step, reason) AS (VALUES {_REASON_ROWS}), n AS (SELECT label, count(*) AS n FROM judged GROUP BY label),
c AS (SELECT n.label, steps.step, steps.reason, n.n, (SELECT count(*) FROM judged j WHERE j.label = n.label AND j.reason = steps.reason) AS dropped FROM n CROSS JOIN steps)
SELECT label, step, reason, dropped, CAST(n - sum(dropped) OVER (PARTITION BY label ORDER BY step) AS BIGINT) AS remaining FROM c""")
_HALF = R.n_bins // 2


def _censor(spark, sf):
    """The band is the second half of the grid; the truth comes from the whole."""
    from dataclasses import replace

    posts = units.dedup_posts(read_events(spark, sf))
    rules = replace(R, n_bins=R.n_bins - _HALF, min_topic=3)
    late = units.topic_bin_counts(posts.withColumn("bin", F.col("bin") - _HALF), rules.n_bins, b.LANG)
    return units.censor_validation(b.series(spark, sf), units.verdicts(units.dense_series(late, rules.n_bins), rules), rules, R.n_bins, _HALF)


_register("censor_validation", _censor, f"""WITH {SMOOTH},
whole AS (SELECT topic, arg_min(bin, (-s, bin)) < {_HALF} AS censored, sum(n_all) FILTER (bin < {_HALF}) / sum(n_all) AS early FROM smooth GROUP BY topic),
late AS (SELECT topic, label, bin, n_all, coalesce(lag(n_all) OVER w, n_all) + n_all + coalesce(lead(n_all) OVER w, n_all) AS s FROM dense WHERE bin >= {_HALF} WINDOW w AS (PARTITION BY topic ORDER BY bin)),
f AS (SELECT topic, sum(n_all) AS total, 100 * max(s) FILTER (bin = {_HALF}) >= {R.left_percent} * max(s) AS flagged FROM late WHERE label = 1 GROUP BY topic HAVING sum(n_all) >= 3),
c AS (SELECT count(*) FILTER (flagged AND censored) AS tp, count(*) FILTER (flagged AND NOT censored) AS fp, count(*) FILTER (NOT flagged AND censored) AS fn, count(*) FILTER (NOT flagged AND NOT censored) AS tn,
  round(avg(early) FILTER (flagged), 4) AS early_share_flagged, round(avg(early) FILTER (NOT flagged), 4) AS early_share_kept FROM f JOIN whole USING (topic))
SELECT *, tp + fp + fn + tn AS n_scored, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 4) END AS accuracy, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall_of_censored,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision_of_flag, CASE WHEN tp + fn > 0 THEN round(fn / (tp + fn), 4) END AS false_negative_rate, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 4) END AS false_positive_rate FROM c""")
S = config.SWEEP
_register("unit_sweep", lambda s, d: units.unit_sweep(units.with_peaks(b.series(s, d), R), R, S), f"""WITH {PEAKS},
grid AS (SELECT * FROM (SELECT unnest({list(S.min_topics)}) AS min_topic) CROSS JOIN (SELECT unnest({list(S.leads)}) AS lead) CROSS JOIN (SELECT unnest({list(S.windows)}) AS window_bins)),
sums AS (SELECT g.*, p.topic, p.label, p.peak_bin, p.peak, sum(m.n_all) AS total, max(m.s) FILTER (m.bin = 0) AS first_s, coalesce(sum(m.s) FILTER (m.bin BETWEEN p.peak_bin + 1 AND p.peak_bin + {R.tail}), 0) AS tail,
  coalesce(sum(m.n_all) FILTER (m.bin >= p.peak_bin - g.lead - g.window_bins AND m.bin < p.peak_bin - g.lead), 0) AS n_all, coalesce(sum(m.n_feat) FILTER (m.bin >= p.peak_bin - g.lead - g.window_bins AND m.bin < p.peak_bin - g.lead), 0) AS n_feat
  FROM grid g CROSS JOIN peaks p JOIN smooth m ON m.topic = p.topic GROUP BY ALL),
v AS (SELECT *, {verdict_sql("min_topic", "lead", "window_bins")} = 'kept' AS kept, {verdict_sql("min_topic", "lead", "window_bins", "n_all")} = 'kept' AS kept_all FROM sums)
SELECT min_topic, lead, window_bins AS "window", count(*) FILTER (kept AND label = 1) AS pos, count(*) FILTER (kept AND label = 0) AS neg, count(*) FILTER (kept_all AND label = 1) AS pos_all, count(*) FILTER (kept_all AND label = 0) AS neg_all,
  count(*) FILTER (kept_all AND label = 1) - count(*) FILTER (kept AND label = 1) AS lost, count(*) FILTER (kept AND label = 1 AND round_even(n_feat / n_all, 4) >= {S.majority}) AS majority_pos, count(*) FILTER (kept AND label = 0 AND round_even(n_feat / n_all, 4) >= {S.majority}) AS majority_neg
FROM v GROUP BY ALL""")


def _tags(spark, sf):
    """Names of two pools: the brands of all parts, and those that end in 1 or 2 as trending names."""
    part = b.table(spark, sf, "part")
    trending = part.filter("right(p_brand, 1) <= '2'").select(cleaning.clean_topic(F.concat(F.lit("#"), F.col("p_brand"))).alias("topic"))
    other = part.select("p_partkey", cleaning.clean_topic(F.concat("p_brand", F.lit(".csv"))).alias("topic"))
    return other, trending


_register("leak_anti_join", lambda s, d: units.without_trending(*_tags(s, d)), "SELECT p_partkey, lower(p_brand) AS topic FROM part WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE right(p_brand, 1) <= '2')")
_register("leak_excluded", lambda s, d: units.excluded_topics(*_tags(s, d)), "SELECT count(DISTINCT lower(p_brand)) AS n_excluded FROM part WHERE lower(p_brand) IN (SELECT lower(p_brand) FROM part WHERE right(p_brand, 1) <= '2')")
_register("window_posts", lambda s, d: b.window_posts(s, d).select("event_id", "topic", "bin", "author", F.get("targets", F.lit(0)).alias("target")), f"WITH {WPOSTS} SELECT event_id, topic, bin, author, target FROM wposts")
_LEADS = (4, 7, 14, 21)
_register("nested_topics", lambda s, d: units.nested_topics(units.with_peaks(b.series(s, d), R), R, _LEADS), f"""WITH {PEAKS}, leads AS (SELECT unnest({list(_LEADS)}) AS lead),
sums AS (SELECT l.lead, p.topic, p.label, p.peak_bin, p.peak, sum(m.n_all) AS total, max(m.s) FILTER (m.bin = 0) AS first_s, coalesce(sum(m.s) FILTER (m.bin BETWEEN p.peak_bin + 1 AND p.peak_bin + {R.tail}), 0) AS tail,
  coalesce(sum(m.n_feat) FILTER (m.bin >= p.peak_bin - l.lead - {R.window} AND m.bin < p.peak_bin - l.lead), 0) AS n_feat FROM leads l CROSS JOIN peaks p JOIN smooth m ON m.topic = p.topic GROUP BY ALL)
SELECT topic, label FROM sums WHERE {verdict_sql(lead="lead")} = 'kept' GROUP BY topic, label HAVING count(*) = {len(_LEADS)}""")
_register("topk_earliest", lambda s, d: units.topk_earliest(read_events(s, d)).select("topic", "event_id", "rank"), f"WITH {POSTS} SELECT topic, event_id, CAST(row_number() OVER (PARTITION BY topic ORDER BY ts, event_id) AS INT) AS rank FROM posts QUALIFY rank <= 150")
_register("rank_pick", lambda s, d: units.rank_pick(b.series(s, d), "topic", "total", 5), f"""WITH {COUNTS}, t AS (SELECT topic, label, CAST(sum(n_all) AS BIGINT) AS total FROM counts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, topic) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM t)
SELECT label, topic, total, CAST(rank AS INT) AS rank FROM r WHERE n <= 5 OR rank IN (SELECT CAST(floor(i * (n - 1) / 4) AS INT) FROM range(0, 5) g(i))""")

# --- graphs and shapes

_register("window_volume", lambda s, d: rounded(network.window_volume(b.window_posts(s, d))), f"WITH {WPOSTS}, {VOLUME} SELECT topic, window_tweets, unique_users, round(tweets_per_user, 6) AS tweets_per_user, round(tweets_per_active_bin, 6) AS tweets_per_active_bin, round(active_bin_frac, 6) AS active_bin_frac FROM volume")
_register("graph_edges", lambda s, d: network.edges(b.window_posts(s, d)), f"WITH {GRAPH} SELECT * FROM edges")
_register("graph_degree", lambda s, d: rounded(network.degrees(b.window_posts(s, d))), f"WITH {GRAPH}, {DEGREE} SELECT topic, n_nodes, n_edges, round(density, 6) AS density, round(edges_per_tweet, 6) AS edges_per_tweet, max_in_degree, round(mean_in_degree, 6) AS mean_in_degree, max_out_degree FROM deg")
_register("graph_reciprocity", lambda s, d: rounded(network.reciprocity(b.window_posts(s, d))), f"WITH {GRAPH} SELECT t.topic, round(coalesce(avg(CASE WHEN r.src IS NOT NULL THEN 1.0 WHEN e.src IS NOT NULL THEN 0.0 END), 0), 6) AS reciprocity FROM (SELECT DISTINCT topic FROM wposts) t LEFT JOIN edges e ON e.topic = t.topic LEFT JOIN edges r ON r.topic = e.topic AND r.src = e.dst AND r.dst = e.src GROUP BY t.topic")
_register("graph_clustering", lambda s, d: rounded(network.clustering(b.window_posts(s, d))), f"""WITH {GRAPH}, nb AS (SELECT topic, a AS v, b AS w FROM und UNION ALL SELECT topic, b, a FROM und),
d AS (SELECT topic, v, count(*) AS d FROM nb GROUP BY ALL), t AS (SELECT x.topic, x.v, count(*) AS t FROM nb x JOIN nb y ON y.topic = x.topic AND y.v = x.v AND x.w < y.w JOIN und u ON u.topic = x.topic AND u.a = x.w AND u.b = y.w GROUP BY ALL),
c AS (SELECT d.topic, sum(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) AS c FROM d LEFT JOIN t ON t.topic = d.topic AND t.v = d.v GROUP BY d.topic)
SELECT s.topic, round(CASE WHEN n >= 2 THEN coalesce(c, 0) / n ELSE 0 END, 6) AS mean_clustering FROM sizes s LEFT JOIN c ON c.topic = s.topic""")
_register("graph_components", lambda s, d: rounded(network.components(b.window_posts(s, d))), f"""WITH RECURSIVE {GRAPH}, nb AS (SELECT topic, a AS v, b AS w FROM und UNION ALL SELECT topic, b, a FROM und),
reach AS (SELECT topic, v, v AS r FROM verts UNION SELECT reach.topic, reach.v, nb.w FROM reach JOIN nb ON nb.topic = reach.topic AND nb.v = reach.r),
comp AS (SELECT topic, c, count(*) AS n FROM (SELECT topic, v, min(r) AS c FROM reach GROUP BY ALL) GROUP BY ALL)
SELECT topic, CASE WHEN sum(n) >= 2 THEN CAST(count(*) AS DOUBLE) ELSE 0 END AS n_components, CASE WHEN sum(n) >= 2 THEN round(max(n) / sum(n), 6) ELSE 0 END AS largest_wcc_frac, CASE WHEN sum(n) >= 2 THEN round(avg(n), 6) ELSE 0 END AS mean_component_size FROM comp GROUP BY topic""")
_CUT = [f"window_start_bin + CAST(floor((window_end_bin - window_start_bin) * {k} / {config.GROWTH_SLICES}) AS INT)" for k in range(4)]
_register("graph_growth", lambda s, d: rounded(network.growth(b.window_posts(s, d), b.kept(s, d), config.GROWTH_SLICES)), f"""WITH {WPOSTS},
sl AS (SELECT topic, author, target, CASE WHEN bin < {_CUT[1]} THEN 0 WHEN bin < {_CUT[2]} THEN 1 ELSE 2 END AS s FROM wposts WHERE author IS NOT NULL),
f AS (SELECT topic, 'n' AS kind, v AS key, min(s) AS s FROM (SELECT topic, author AS v, s FROM sl UNION ALL SELECT topic, target, s FROM sl WHERE target IS NOT NULL) GROUP BY ALL
  UNION ALL SELECT topic, 'e', author || '>' || target, min(s) FROM sl WHERE target IS NOT NULL GROUP BY ALL UNION ALL SELECT topic, 'a', author, min(s) FROM sl GROUP BY ALL),
c AS (SELECT topic, kind, count(*) FILTER (s <= 0) AS c0, count(*) AS c2, count(*) FILTER (s = 2) AS late FROM f GROUP BY ALL),
p AS (SELECT t.topic, n.c0 AS n0, n.c2 AS n2, coalesce(e.c0, 0) AS e0, coalesce(e.c2, 0) AS e2, a.c0 AS a0, a.c2 AS a2, a.late FROM (SELECT DISTINCT topic FROM f) t LEFT JOIN c n ON n.topic = t.topic AND n.kind = 'n' LEFT JOIN c e ON e.topic = t.topic AND e.kind = 'e' LEFT JOIN c a ON a.topic = t.topic AND a.kind = 'a')
SELECT topic, round((n2 - n0) / 2.0 / greatest(n2, 1), 6) AS node_growth_slope, round((e2 - e0) / 2.0 / greatest(e2, 1), 6) AS edge_growth_slope, round((a2 - a0) / 2.0 / greatest(a2, 1), 6) AS author_growth_slope, round(greatest(e2, 1) / greatest(n2, 1), 6) AS edge_node_ratio_final, round(late / greatest(n2, 1), 6) AS new_author_frac_last_slice FROM p""")
_register("graph_kcore2", lambda s, d: network.whole_graph_features(b.window_posts(s, d), ("cores",)).select("topic", F.round("core2_frac", 6).alias("core2_frac"), "max_core"))
_register("graph_centrality", lambda s, d: rounded(network.whole_graph_features(b.window_posts(s, d), ("page_rank", "betweenness")).select("topic", "pagerank_gini", "max_pagerank", "max_betweenness", "mean_betweenness", "betweenness_gini", "meta_betweenness_exact")))
_register("graph_communities", lambda s, d: rounded(network.whole_graph_features(b.window_posts(s, d), ("communities",)).select("topic", "n_communities", "modularity", "largest_community_frac", "community_entropy")))
_register("shape_features", lambda s, d: rounded(temporal.shape_features(b.windows(s, d), R.window)), f"WITH {SHAPE} SELECT topic, {SHAPES} FROM shape")
_register("arima_features", lambda s, d: rounded(temporal.arima_features(b.windows(s, d)), 4))
_register("arima_order_grid", lambda s, d: rounded(temporal.order_summary(temporal.order_grid(b.windows(s, d))), 4))
_register("stationarity", lambda s, d: temporal.stationarity(b.windows(s, d)))

# --- texts

_KEYED = r"""keyed AS (SELECT source AS topic, substr(sha1(encode(text)), 1, 16) AS key, text FROM documents WHERE text IS NOT NULL AND trim(text, E' \t\n\r\x0b\x0c') <> ''),
w AS (SELECT DISTINCT key, CAST('0x' || substr(key, 1, 4) AS BIGINT) + 1.0 AS a, CAST('0x' || substr(key, 5, 4) AS BIGINT) + 1.0 AS b, CAST('0x' || substr(key, 9, 4) AS BIGINT) + 1.0 AS c FROM keyed),
cache AS (SELECT key, a / (a + b + c) AS p_neg, b / (a + b + c) AS p_neu, c / (a + b + c) AS p_pos FROM w)"""
_register("text_key_cache", lambda s, d: rounded(sentiment.score_cache(b.keyed_texts(s, d), None)), f"WITH {_KEYED} SELECT key, round(p_neg, 6) AS p_neg, round(p_neu, 6) AS p_neu, round(p_pos, 6) AS p_pos FROM cache")
_register("sent_aggregate", lambda s, d: rounded(sentiment.sentiment_features(b.keyed_texts(s, d), sentiment.score_cache(b.keyed_texts(s, d), None))), f"""WITH {_KEYED},
r AS (SELECT topic, p_pos - p_neg AS v, 1 - p_neu AS st, CASE WHEN p_neg >= p_neu AND p_neg >= p_pos THEN 0 WHEN p_neu >= p_pos THEN 1 ELSE 2 END AS k FROM keyed JOIN cache USING (key)),
m AS (SELECT topic, avg(v) AS mv, stddev_pop(v) AS sv FROM r GROUP BY topic)
SELECT topic, round(avg(v), 6) AS sent_mean, round(var_pop(v), 6) AS sent_var, round(avg(st), 6) AS sent_intensity, round(avg(CASE WHEN abs(v) >= {sentiment.STRONG} THEN 1.0 ELSE 0 END), 6) AS sent_strong_frac,
  round(avg(CASE WHEN k = 2 THEN 1.0 ELSE 0 END), 6) AS sent_pos_frac, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0 END), 6) AS sent_neg_frac, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0 END), 6) AS sent_neu_frac,
  round(CASE WHEN max(sv) > 1e-9 THEN avg(((v - mv) / sv) ** 3) ELSE 0 END, 6) AS sent_skew, count(*) AS meta_sent_n,
  round(2 * least(avg(CASE WHEN k = 2 THEN 1.0 ELSE 0 END), avg(CASE WHEN k = 0 THEN 1.0 ELSE 0 END)), 6) AS sent_polarisation FROM r JOIN m USING (topic) GROUP BY topic""")
_LANGS = ("click", "error", "purchase", "signup", "view")
_register("language_mix", lambda s, d: rounded(sentiment.language_mix(read_events(s, d), _LANGS)), f"WITH {POSTS} SELECT topic, label, count(*) AS lang_total, count(DISTINCT lang) AS lang_n_distinct, {', '.join(f"round(avg(CASE WHEN lang = '{x}' THEN 1.0 ELSE 0 END), 6) AS lang_{x}" for x in _LANGS)} FROM posts GROUP BY topic, label")
_register("top_languages", lambda s, d: sentiment.top_languages(read_events(s, d)), f"WITH {POSTS} SELECT lang, count(*) AS n FROM posts GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
_register("lead_bins", lambda s, d: sentiment.lead_bins(b.kept(s, d), _LEADS, R.window), f"WITH {UNITS} SELECT DISTINCT u.topic, CAST(g.bin AS INT) AS bin FROM units u CROSS JOIN (SELECT unnest({list(_LEADS)}) AS lead) l CROSS JOIN range(0, {R.n_bins}) g(bin) WHERE g.bin >= greatest(u.peak_bin - l.lead - {R.window}, 0) AND g.bin < u.peak_bin - l.lead")
_register("workload_sizing", lambda s, d: rounded(sentiment.workload(b.texts(s, d))), f"""WITH {_KEYED} SELECT count(*) AS n_texts, count(DISTINCT key) AS n_distinct, quantile_cont(length(text), 0.5) AS chars_p50, quantile_cont(length(text), 0.9) AS chars_p90, quantile_cont(length(text), 0.99) AS chars_p99, CAST(max(length(text)) AS INT) AS chars_max,
round(avg(length(text) / 4.0), 6) AS tokens_at_4, round(avg(length(text) / 3.2), 6) AS tokens_at_3_2, round(avg(CASE WHEN length(text) / 4.0 > 128 THEN 1.0 ELSE 0 END), 6) AS over_128 FROM keyed""")

# --- matrix, audit, metrics

_register("feature_matrix", lambda s, d: rounded(b.features(s, d).select("topic", "label", *b.SQL_FEATURES)), f"WITH {MATRIX} SELECT topic, label, {', '.join(f'round({c}, 6) AS {c}' if c not in ('window_tweets', 'unique_users', 'n_nodes', 'n_edges') else c for c in b.SQL_FEATURES)} FROM feats")
_RANKED = "ranked AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM long)"
_register("univariate_auc", lambda s, d: rounded(evaluation.univariate_auc(_long(s, d))), f"""WITH {MATRIX}, {_RANKED}, a AS (SELECT feature, sum(label) AS np, count(*) - sum(label) AS nn, sum(r * label) AS rp FROM ranked GROUP BY feature),
u AS (SELECT feature, CASE WHEN np > 0 AND nn > 0 THEN (rp - np * (np + 1) / 2.0) / (np * nn) ELSE 0.5 END AS auc FROM a) SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc FROM u""")
_register("size_audit", lambda s, d: rounded(evaluation.size_audit(rounded(b.features(s, d)), b.SQL_FEATURES, config.VOLUME_PROXY)), f"""WITH {MATRIX}, {_RANKED}, pr AS (SELECT topic, r AS rs FROM ranked WHERE feature = '{config.VOLUME_PROXY}'),
j AS (SELECT feature, r, rs FROM ranked JOIN pr USING (topic)), m AS (SELECT feature, avg(r) AS mr, avg(rs) AS ms FROM j GROUP BY feature),
c AS (SELECT feature, sum((r - mr) * (rs - ms)) AS c, sum((r - mr) * (r - mr)) AS v, sum((rs - ms) * (rs - ms)) AS s FROM j JOIN m USING (feature) GROUP BY feature)
SELECT feature, round(CASE WHEN v > 0 AND s > 0 THEN c / sqrt(v * s) ELSE 0 END, 6) AS rho, abs(CASE WHEN v > 0 AND s > 0 THEN c / sqrt(v * s) ELSE 0 END) >= 0.4 AS flagged FROM c""")
_register("class_summary", lambda s, d: rounded(evaluation.class_summary(_long(s, d)), 5), f"WITH {MATRIX} SELECT feature, round(avg(value) FILTER (label = 1), 5) AS mean_pos, round(avg(value) FILTER (label = 0), 5) AS mean_neg, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0 END), 5) AS zero_frac FROM long GROUP BY feature")
_register("top_separators", lambda s, d: rounded(evaluation.univariate_auc(_long(s, d))).orderBy(F.desc("auc"), "feature").limit(8), _sql["univariate_auc"] + " ORDER BY auc DESC, feature LIMIT 8")
_register("quantiles_by_class", lambda s, d: rounded(evaluation.quantiles_by_class(_long(s, d)), 5), f"WITH {MATRIX} SELECT feature, label, {', '.join(f'round(quantile_cont(value, {q}), 5) AS p{int(100 * q)}' for q in (0.0, 0.25, 0.5, 0.75, 1.0))} FROM long GROUP BY feature, label")
_Z = """x AS (SELECT *, abs(z) / sqrt(2) AS y, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS k FROM zs)"""
_PV = "round(k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-y * y), 6) AS p_value"
_register("mann_whitney", lambda s, d: rounded(evaluation.mann_whitney(_long(s, d))), f"""WITH {MATRIX}, {_RANKED}, a AS (SELECT feature, CAST(sum(label) AS DOUBLE) AS n1, CAST(count(*) - sum(label) AS DOUBLE) AS n2, sum(r * label) AS r1 FROM ranked GROUP BY feature),
t AS (SELECT feature, sum(CAST(t AS DOUBLE) ** 3 - t) AS ties FROM (SELECT feature, value, count(*) AS t FROM long GROUP BY ALL) GROUP BY feature),
b AS (SELECT a.*, ties, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM a JOIN t USING (feature)),
zs AS (SELECT feature, u, CASE WHEN sd > 0 THEN greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd ELSE 0 END AS z FROM b), {_Z} SELECT feature, round(u, 6) AS u, round(z, 6) AS z, {_PV} FROM x""")
_register("wilcoxon", lambda s, d: rounded(evaluation.wilcoxon(b.table(s, d, "orders").join(b.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("test"), "c_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("a"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("b")))), f"""WITH pairs AS (SELECT c_mktsegment AS test, c_custkey, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT test, d, rank() OVER (PARTITION BY test ORDER BY abs(d)) + (count(*) OVER (PARTITION BY test, abs(d)) - 1) / 2.0 AS r FROM pairs WHERE d <> 0),
t AS (SELECT test, sum(CAST(t AS DOUBLE) ** 3 - t) AS ties FROM (SELECT test, abs(d) AS a, count(*) AS t FROM pairs WHERE d <> 0 GROUP BY ALL) GROUP BY test),
a AS (SELECT test, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r GROUP BY test),
zs AS (SELECT a.*, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM a JOIN t USING (test)), {_Z}
SELECT test, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(z, 6) AS z, {_PV} FROM x""")
_register("pr_curve", lambda s, d: rounded(evaluation.pr_curve(b.scores(s, d))), f"WITH {CURVE} SELECT arm, p, round(tp / (tp + fp), 6) AS precision, round(tp / n_pos, 6) AS recall, round(fp / n_neg, 6) AS fpr FROM curve")
_register("avg_precision", lambda s, d: rounded(evaluation.average_precision(b.scores(s, d))), f"WITH {CURVE} SELECT arm, round(sum(pos / n_pos * (tp / (tp + fp))), 6) AS pr_auc, round(max(n_pos) / (max(n_pos) + max(n_neg)), 6) AS prevalence, round(sum(pos / n_pos * (tp / (tp + fp))) - max(n_pos) / (max(n_pos) + max(n_neg)), 6) AS lift FROM curve GROUP BY arm")
_register("roc_auc", lambda s, d: rounded(evaluation.roc_auc(b.scores(s, d))), f"WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY arm ORDER BY p) + (count(*) OVER (PARTITION BY arm, p) - 1) / 2.0 AS r FROM scores), a AS (SELECT arm, CAST(sum(label) AS DOUBLE) AS np, CAST(count(*) - sum(label) AS DOUBLE) AS nn, sum(r * label) AS rp FROM r GROUP BY arm) SELECT arm, round((rp - np * (np + 1) / 2) / (np * nn), 6) AS roc_auc FROM a")
_register("threshold_metrics", lambda s, d: rounded(evaluation.threshold_metrics(b.scores(s, d))), f"""WITH {SCORES}, c AS (SELECT arm, count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp, count(*) FILTER (p < 0.5 AND label = 1) AS fn, count(*) FILTER (p < 0.5 AND label = 0) AS tn FROM scores GROUP BY arm)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")


def _pairs(spark, sf):
    return b.table(spark, sf, "labels").select(F.col("quality").alias("label"), (F.col("doc_id") % 7 / 6.0).alias("p_a"), (F.col("doc_id") % 5 / 4.0).alias("p_b"))


_register("mcnemar", lambda s, d: rounded(evaluation.mcnemar(_pairs(s, d))), """WITH r AS (SELECT CAST(doc_id % 7 / 6.0 >= 0.5 AS INT) = quality AS a, CAST(doc_id % 5 / 4.0 >= 0.5 AS INT) = quality AS b FROM labels),
n AS (SELECT count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01 FROM r)
SELECT n10, n01, round(CASE WHEN n10 + n01 = 0 THEN 1 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n10 + n01 + 1) - lgamma(k + 1) - lgamma(n10 + n01 - k + 1) - (n10 + n01) * ln(2))) FROM range(0, least(n10, n01) + 1) g(k))) END, 6) AS p_value FROM n""")
_register("fold_assignment", lambda s, d: evaluation.fold_assignment(b.judged(s, d).select("topic", "label"), "topic"), f"WITH {JUDGED} SELECT topic, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(topic || ':42'), topic) - 1) % 5 AS INT) AS fold FROM judged")
_RESID = ["unique_users", "n_nodes", "peakedness", "bin_entropy"]
_register("residualise", lambda s, d: rounded(evaluation.residualise(evaluation.fold_assignment(rounded(b.features(s, d)), "topic"), _RESID, config.VOLUME_PROXY), 5), f"""WITH {MATRIX}, fo AS (SELECT topic, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(topic || ':42'), topic) - 1) % 5 AS INT) AS fold FROM feats),
l AS (SELECT fo.fold, l.topic, l.feature, l.value, f.window_tweets AS x FROM long l JOIN fo USING (topic) JOIN feats f USING (topic) WHERE feature IN ({', '.join(f"'{c}'" for c in _RESID)})),
k AS (SELECT t.fold, t.feature, regr_slope(r.value, r.x) AS s, regr_intercept(r.value, r.x) AS i, avg(r.value) AS m FROM (SELECT DISTINCT fold, feature FROM l) t JOIN l r ON r.feature = t.feature AND r.fold <> t.fold GROUP BY ALL)
SELECT l.topic, l.fold, l.feature, round(l.value - coalesce(k.i, k.m) - coalesce(k.s, 0) * l.x, 5) + 0.0 AS residual FROM l JOIN k USING (fold, feature)""")
_register("share_histogram", lambda s, d: evaluation.share_histogram(b.table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.round(F.col("l_quantity") / 50, 6).alias("v")), "v"), "SELECT CAST(l_returnflag = 'R' AS INT) AS label, CAST(least(floor(round(l_quantity / 50, 6) * 25), 24) AS INT) AS bin, count(*) AS n FROM lineitem WHERE round(l_quantity / 50, 6) BETWEEN 0 AND 1 GROUP BY ALL")
_register("bootstrap_ci", lambda s, d: rounded(evaluation.bootstrap_ci(b.table(s, d, "labels").select(F.lit("doc").alias("arm"), F.col("doc_id").alias("key"), F.col("quality").alias("label"), (F.col("doc_id") % 101 / 100.0).alias("p")))))

_register("window_language_mix", lambda s, d: rounded(b.window_mix(s, d)), f"""WITH {UNITS}, w AS (SELECT p.topic, coalesce(p.lang, 'unk') AS lang FROM first_posts p JOIN units u ON u.topic = p.topic AND p.bin >= u.window_start_bin AND p.bin < u.window_end_bin)
SELECT u.topic, u.label, count(w.lang) AS lang_total, count(DISTINCT w.lang) AS lang_n_distinct, {', '.join(f"round(coalesce(avg(CASE WHEN w.lang = '{x}' THEN 1.0 WHEN w.lang IS NOT NULL THEN 0.0 END), 0), 6) AS lang_{x}" for x in _LANGS)}
FROM units u LEFT JOIN w ON w.topic = u.topic GROUP BY u.topic, u.label""")
_register("unit_sentiment", lambda s, d: rounded(b.unit_sentiment(s, d).select("topic", "meta_sent_n", "sent_mean", "sent_var", "sent_neg_frac", "sent_pos_frac", "sent_strong_frac"), 5), f"""WITH {UNITS},
t AS (SELECT p.topic, substr(sha1(d.text), 1, 16) AS key FROM first_posts p JOIN units u ON u.topic = p.topic AND p.bin >= greatest(u.window_start_bin, 0) AND p.bin < u.window_end_bin JOIN documents d ON d.doc_id = p.event_id WHERE p.lang = '{b.LANG}' AND trim(d.text, E' \\t\\n\\r\\x0b\\x0c') <> ''),
v AS (SELECT topic, CAST('0x' || substr(key, 1, 4) AS BIGINT) + 1.0 AS a, CAST('0x' || substr(key, 5, 4) AS BIGINT) + 1.0 AS b, CAST('0x' || substr(key, 9, 4) AS BIGINT) + 1.0 AS c FROM t),
r AS (SELECT topic, a / (a + b + c) AS neg, b / (a + b + c) AS neu, c / (a + b + c) AS pos FROM v)
SELECT u.topic, count(r.neg) AS meta_sent_n, round(coalesce(avg(pos - neg), 0), 5) AS sent_mean, round(coalesce(var_pop(pos - neg), 0), 5) AS sent_var,
  round(coalesce(avg(CASE WHEN neg >= neu AND neg >= pos THEN 1.0 WHEN neg IS NOT NULL THEN 0.0 END), 0), 5) AS sent_neg_frac,
  round(coalesce(avg(CASE WHEN NOT (neg >= neu AND neg >= pos) AND NOT neu >= pos THEN 1.0 WHEN neg IS NOT NULL THEN 0.0 END), 0), 5) AS sent_pos_frac,
  round(coalesce(avg(CASE WHEN abs(pos - neg) >= {sentiment.STRONG} THEN 1.0 WHEN neg IS NOT NULL THEN 0.0 END), 0), 5) AS sent_strong_frac
FROM units u LEFT JOIN r ON r.topic = u.topic GROUP BY u.topic""")

# --- models: rows only, at the operators' defaults


def _fusion() -> config.Arm:
    return next(a for a in config.ARMS if a.name == "full_fusion")


def _volume() -> config.Arm:
    return next(a for a in config.ARMS if a.name == "volume_only")


_register("gbt_oof", lambda s, d: rounded(models.oof_scores(b.full_matrix(s, d))))
_register("ablation", lambda s, d: rounded(studies.ablation(b.full_matrix(s, d))))
_register("permutation_importance", lambda s, d: rounded(models.permutation_importance(b.full_matrix(s, d), config.arm_columns(_fusion()))))
_register("language_control", lambda s, d: rounded(studies.language_control(s, d)))
_register("lead_time", lambda s, d: rounded(studies.lead_time(s, d)))
_register("robustness", lambda s, d: rounded(studies.robustness(s, d)))
_register("repeated_cv", lambda s, d: rounded(studies.repeated_cv(b.features(s, d), _volume())))
_register("permutation_test", lambda s, d: rounded(studies.permutation_test(b.features(s, d), _volume())))
_register("random_forest", lambda s, d: rounded(models.random_forest_scores(b.features(s, d), config.arm_columns(_volume()))))
_register("impurity_importance", lambda s, d: rounded(models.impurity_importance(b.features(s, d), config.arm_columns(_volume()))))
_register("early_features", lambda s, d: rounded(prototype.early_features(with_previous(read_events(s, d)))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
