"""Relational complement (joins, sets, windows, grouping, types, sketches) and streaming forms, over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temporis.operators import agent
from temporis.plans import tool_queries
from temporis.registry import query
from temporis.session import table
from temporis.streaming import live, runs

#: Revenue has four decimals; as decimals its sums don't depend on their order.
REVENUE = "cast(l_extendedprice * (1 - l_discount) as decimal(18,4))"


@query("rel_q1_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.sum(F.expr(REVENUE)).cast("double").alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("rel_q3_star_join", "SELECT o_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate")
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(REVENUE).alias("x"))
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.sum("x").cast("double").alias("revenue"))


@query("rel_q5_region", "SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY 1")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    l = t("lineitem").select("l_orderkey", "l_suppkey", F.expr(REVENUE).alias("x"))
    joined = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return joined.groupBy("n_name").agg(F.sum("x").cast("double").alias("revenue"))


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @query(f"rel_join_{_how}", f"SELECT c_custkey, o_orderkey FROM customer {_sql} orders ON c_custkey = o_custkey")
    def _join(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
        return c.join(o, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "o_orderkey")


@query("rel_join_cross", "SELECT n_name, r_name, count(*) AS customers FROM nation CROSS JOIN region JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with every region: two tables of fixed size, of which the smaller is broadcast."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_name")))
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.join(counts, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers")


@query("rel_join_range", "SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey AND l_quantity BETWEEN p_size - 2 AND p_size + 2")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    near = F.col("l_quantity").between(F.col("p_size") - 2, F.col("p_size") + 2)
    return p.join(l, (F.col("p_partkey") == F.col("l_partkey")) & near).select("p_partkey", "l_orderkey", "l_linenumber")


@query("rel_join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("rel_join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("rel_lateral", "SELECT doc_id, i AS word_no, w AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents) WHERE w <> ''")
def lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    return words.where("word <> ''").withColumn("word_no", F.col("word_no").cast("long"))


@query("rel_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("rel_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rel_grouping_sets", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count("*").alias("n"))


@query("rel_distinct_agg", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def distinct_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.sum_distinct("o_custkey").alias("total"))


@query("rel_pivot", "SELECT l_returnflag, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS f, CAST(count_if(l_linestatus = 'O') AS BIGINT) AS o FROM lineitem GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count("l_orderkey"))
    return wide.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


for _name, _sql, _set in (
    ("union_all", "UNION ALL", lambda a, b: a.unionByName(b)), ("union", "UNION", lambda a, b: a.unionByName(b).distinct()),
    ("intersect", "INTERSECT", DataFrame.intersect), ("intersect_all", "INTERSECT ALL", DataFrame.intersectAll),
    ("except", "EXCEPT", DataFrame.subtract), ("except_all", "EXCEPT ALL", DataFrame.exceptAll),
):

    @query(f"rel_{_name}", f"SELECT o_custkey AS k FROM orders {_sql} SELECT c_custkey AS k FROM customer")
    def _sets(spark: SparkSession, sf_dir: str, of=_set) -> DataFrame:
        return of(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("rel_window_ranking", "SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER v AS INTEGER) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus), v AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderstatus"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(v).alias("q"))


@query("rel_window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("moving"), F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"))


@query("rel_dates", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.trunc(d, "month").alias("month"), F.year(d).alias("year"), F.date_add(d, 30).alias("due"))


@query("rel_top_customers", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)


@query("rel_approximate", "SELECT o_orderstatus, true AS customers_near, true AS prices_near FROM orders GROUP BY 1")
def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against exact figures: a distinct count within 15 % (its standard error is 5 %), and percentiles whose rank is off by 1 % at most."""
    rows = table(spark, sf_dir, "orders")
    exact = rows.groupBy("o_orderstatus").agg(
        F.count_distinct("o_custkey").alias("n"), F.approx_count_distinct("o_custkey", 0.05).alias("a"), F.percentile_approx("o_totalprice", [0.5, 0.9], 1000).alias("p"),
        F.percentile("o_totalprice", [0.49, 0.89]).alias("low"), F.percentile("o_totalprice", [0.51, 0.91]).alias("high"),
    )
    near = F.forall(F.arrays_zip("p", "low", "high"), lambda x: (x["p"] >= x["low"]) & (x["p"] <= x["high"]))
    return exact.select("o_orderstatus", (F.abs(F.col("a") - F.col("n")) <= 0.15 * F.col("n") + 1).alias("customers_near"), near.alias("prices_near"))


@query(
    "rel_sketches",
    """WITH d AS (SELECT date_trunc('month', ts) AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT month, CAST(sum(n) AS BIGINT) AS n, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS top, true AS users_near, true AS one_pass_near, true AS ranks_near FROM d GROUP BY 1""",
)
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of days, kept, then merged to months. Their counts and most frequent kinds are exact; distinct users and ranks of amounts are held against exact
    figures, and against the sketch of a month made in one pass, within the stated errors."""
    from temporis.functions import sketches as S
    from temporis.plans.saving import saver

    rows = table(spark, sf_dir, "events")
    day, month = F.date_trunc("day", "ts").alias("day"), F.date_trunc("month", "day").alias("month")
    kept = saver(spark)(S.sketched(rows, [day], "user_id", "value", "event_type"), "day-sketches")
    told = S.read(S.merged(kept, [month]), ["month"], [0.5, 0.9], 8)
    of_month = rows.withColumn("month", F.date_trunc("month", "ts"))
    once = S.read(S.sketched(of_month, ["month"], "user_id", "value", "event_type"), ["month"], [0.5], 8).select("month", F.col("users").alias("users_once"), F.col("quantiles").alias("quantiles_once"))
    exact = of_month.groupBy("month").agg(F.count_distinct("user_id").alias("exact"), F.percentile("value", [0.5 - S.RANK_ERROR, 0.9 - S.RANK_ERROR]).alias("low"), F.percentile("value", [0.5 + S.RANK_ERROR, 0.9 + S.RANK_ERROR]).alias("high"))
    both = told.join(once, "month").join(exact, "month")
    within = lambda q: F.forall(F.arrays_zip(F.col(q).alias("q"), F.slice("low", 1, F.size(q)).alias("low"), F.slice("high", 1, F.size(q)).alias("high")), lambda x: (x["q"] >= x["low"]) & (x["q"] <= x["high"]))
    ordered = F.array_sort(F.transform("top", lambda x: F.struct((-x["count"]).alias("below"), x["item"].alias("item"))))
    said = F.array_join(F.transform(ordered, lambda x: F.concat_ws("=", x["item"], (-x["below"]).cast("string"))), ",")
    return both.select(
        F.col("month").cast("timestamp_ntz").alias("month"), "n", said.alias("top"), S.distinct_is_near(F.col("users"), F.col("exact")).alias("users_near"),
        (S.distinct_is_near(F.col("users_once"), F.col("exact")) & within("quantiles_once")).alias("one_pass_near"), within("quantiles").alias("ranks_near"),
    )


@query("rel_udaf", "SELECT event_type AS kind, round(exp(avg(ln(1 + abs(value)))), 6) AS mean FROM events GROUP BY 1")
def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate function of one's own, a geometric mean, over what partitions have summed."""
    from temporis.functions import own

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value")
    return own.geometric_means(rows, "kind", "value").withColumn("mean", F.round("mean", 6))


@query("rel_udf_arrow", "SELECT doc_id, list_sum(list_transform(string_split(text, ''), lambda c: CAST(ord(c) AS BIGINT))) AS codes FROM documents")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function of one's own over Arrow arrays, of whole texts."""
    from temporis.functions import own

    return table(spark, sf_dir, "documents").select("doc_id", own.code_point_sum("text").alias("codes"))


@query("rel_udtf", "SELECT conv_id, turn, i AS place, CAST(ord(substr(role, i + 1, 1)) AS INTEGER) AS code FROM (SELECT conv_id, turn, role, unnest(range(length(role))) AS i FROM conversations)")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of one's own, applied to the whole table."""
    from temporis.functions import own

    return own.code_points(table(spark, sf_dir, "conversations"), "role")


@query("stream_tumbling_batch", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = runs.outcome(live.windowed_counts(runs.source(spark, sf_dir, "events")), "tumbling")
    return done.withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_sliding",
    "SELECT time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events, range(3) r(i) GROUP BY 1, 2",
)
def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a quarter of an hour, a new one every five minutes, as a stream."""
    done = runs.outcome(live.windowed_counts(runs.source(spark, sf_dir, "events"), "15 minutes", "5 minutes"), "sliding")
    return done.withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_sessions_live",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.outcome(live.sessions(runs.source(spark, sf_dir, "events")), "sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_pairs",
    "SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR",
)
def pairs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined: views and the clicks of the same user within two hours after them."""
    events = runs.source(spark, sf_dir, "events")
    return runs.outcome(live.followed(events.where("event_type = 'view'"), events.where("event_type = 'click'"), "2 hours"), "pairs", "append").drop("batch")


@query("stream_conversations", "SELECT conv_id, CAST(count_if(role = 'assistant') AS BIGINT) AS rounds, count(*) AS n_messages FROM conversations GROUP BY 1")
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = runs.outcome(live.conversation_state(runs.source(spark, sf_dir, "conversations")), "conversations", "update")
    last = updates.groupBy("conv_id").agg(F.max_by(F.struct("rounds", "n_messages"), F.struct("batch", "n_messages")).alias("x"))
    return last.select("conv_id", "x.rounds", "x.n_messages")


#: Turns of conversations with written-in calls, as a stream: those up to the second in a first batch, the others in another, then a turn a day later, by which the others' time is up.
@query(
    "stream_closed_conversations",
    f"""WITH {tool_queries.REPLAY_SQL}, t AS (SELECT conv_id, CAST(sum({" + ".join(f"(length(text) - length(replace(text, '{tag}', ''))) // {len(tag)}" for tag in agent.TOOL_TAGS)}) AS BIGINT) AS calls FROM turns WHERE role = 'assistant' GROUP BY 1)
SELECT l.conv_id, CAST(count_if(role = 'assistant') AS BIGINT) AS rounds, coalesce(max(CASE WHEN turn = stop THEN regexp_extract(regexp_extract(text, '<answer>(.*)</answer>', 1), '[A-Z]') END), 'No final answer provided within maximum rounds') AS answer,
  count(*) AS n_messages, CAST(count_if(role = 'assistant' AND has_tool) AS BIGINT) AS tool_turns, coalesce(any_value(calls), 0) AS calls FROM l LEFT JOIN t USING (conv_id) GROUP BY l.conv_id""",
)
def closed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that a timer closes, equal to their replay."""
    from temporis.streaming import stateful

    turns = tool_queries.turns(spark, sf_dir).select("conv_id", "turn", "role", "text", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("turn"))).alias("at"))
    later = spark.createDataFrame([(-1, 0, "user", "")], "conv_id long, turn long, role string, text string").withColumn("at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    stream = runs.in_turn(spark, [turns.where("turn <= 2"), turns.where("turn > 2"), later], "turns-in-turn")
    done = runs.outcome(stateful.closed_conversations(stream), "closed-conversations", "append", rocks=True).where("kind = 'closed'")
    return done.select("conv_id", "rounds", "answer", "n_messages", "tool_turns", F.aggregate(F.map_values("tools"), F.lit(0).cast("long"), lambda s, x: s + x).alias("calls"))
