"""The event log: counters, windows, cursors, daily series; and the plain relational operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenaria.functions.text import fold, paris_day, percent_text
from plenaria.operators import lookups, state
from plenaria.operators.topk import top_k
from plenaria.sources.tables import table


def z1_counters(spark, sf_dir):
    """Events of each user by type, as counters."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last"))


def z2_windows(spark, sf_dir):
    """Windows of an hour that a user's first event opens."""
    return state.anchored_windows(table(spark, sf_dir, "events", "user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3600)


def z3_interactions(spark, sf_dir):
    """Events that cost their user one: views are types with their JSON value, interactions days."""
    own = table(spark, sf_dir, "events").withColumn("view", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))).withColumn("interaction", F.date_format("ts", "yyyy-MM-dd HH"))
    found = state.counted_once(own.select("event_id", "user_id", "ts", "view", "interaction"), "user_id", "interaction", "view", "ts", "event_id", 30, 4)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("counted").alias("counted"))


def z4_quota(spark, sf_dir):
    """The larger of a user's two counters, and what is left of 300."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("b"))
    used = F.greatest("a", "b")
    return own.select("user_id", F.least(used, F.lit(300)).alias("used"), F.greatest(F.lit(300) - used, F.lit(0)).alias("remaining"))


def z5_daily(spark, sf_dir):
    """Events and value of each user by day in Paris."""
    return table(spark, sf_dir, "events").groupBy("user_id", paris_day("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))


def z6_last_days(spark, sf_dir):
    """Events by type in all, in the last seven days and on the last."""
    own = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = own.agg(F.max("day")).first()[0]
    inside = lambda n: F.sum(F.when(F.col("day") > F.date_sub(F.lit(last).cast("date"), n), 1).otherwise(0))
    return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("all_days"), inside(7).alias("last_7"), inside(1).alias("last_1"))


def z7_cursor(spark, sf_dir):
    """What is new to each user since the last purchase."""
    own = table(spark, sf_dir, "events")
    cursors = own.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("seen"))
    return state.after_cursor(own, cursors, "user_id", "ts", "seen").groupBy("user_id").agg(F.count(F.lit(1)).alias("new"), F.min("ts").alias("first_new"))


def z8_purge(spark, sf_dir):
    """Events that are kept twenty days back from the last."""
    own = table(spark, sf_dir, "events")
    last = own.agg(F.max("ts")).first()[0]
    return own.where(~state.expired("ts", F.lit(last).cast(own.schema["ts"].dataType), 20)).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


def z9_series(spark, sf_dir):
    """Errors of every user who had one on each of the last thirty days, zeros included."""
    own = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("day", F.to_date("ts"))
    last = own.agg(F.max("day")).first()[0]
    return state.gap_filled(own.select("user_id", "day"), "day", ["user_id"], 30, F.lit(last).cast("date")).withColumn("day", F.col("day").cast("string"))


def t27_json(spark, sf_dir):
    """Numbers in the JSON of events, a fallback where there is none, and validity."""
    own = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return own.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.try_parse_json("props").isNotNull().cast("int").alias("valid"), F.coalesce(F.from_json("props", "missing bigint")["missing"], F.lit(0)).alias("missing"))


def f_filters(spark, sf_dir):
    """Ranges, lists, prefixes, patterns and null-safe inequality together."""
    own = table(spark, sf_dir, "orders")
    kept = own.where(
        F.col("o_orderdate").between("1996-01-01", "1999-12-31") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")
        & F.col("o_orderpriority").startswith("1") & F.col("o_orderpriority").ilike("%urg%") & (F.instr("o_orderpriority", "LOW") == 0) & ~F.col("o_custkey").eqNullSafe(F.lit(1))
    )
    return kept.select("o_orderkey", F.length("o_orderpriority").alias("n"), F.when(F.col("o_totalprice") > 1000, "large").otherwise("small").alias("size"))


def f5_semi_anti(spark, sf_dir):
    """Customers with an urgent order but none of another kind of priority."""
    cust, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    urgent = orders.where("o_orderpriority like '1%'").select("c_custkey")
    low = orders.where("o_orderpriority like '5%'").select("c_custkey")
    return cust.join(urgent, "c_custkey", "left_semi").join(low, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


def j2_three_way(spark, sf_dir):
    """Revenue of each nation and region through three inner joins."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    by_customer = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(revenue.alias("r"))
    joined = by_customer.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


def j3_left_counts(spark, sf_dir):
    """Orders of every customer, none included."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return table(spark, sf_dir, "customer", "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


def j5_composite(spark, sf_dir):
    """Lines whose part and supplier recur in another order, joined on both keys."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    pairs = items.groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders")).where("orders >= 2")
    return items.join(pairs, ["l_partkey", "l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.max("orders").alias("most"))


def j6_scalar_sum(spark, sf_dir):
    """Each customer's spending in 1997 next to all of it, from one aggregate each instead of a correlated one."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.coalesce(F.sum(F.when(F.year("o_orderdate") == 1997, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("in_1997"))
    return own.where("total > 0")


def j10_latest_order(spark, sf_dir):
    """Status and priority of each customer's latest order."""
    return lookups.latest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def a1_global(spark, sf_dir):
    """Count, sums, extremes and distinct counts in one pass."""
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
        F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"),
    )


def a2_pricing(spark, sf_dir):
    """The pricing summary by return flag and line status."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '2001-06-01'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("lines"),
    )


def a4_having(spark, sf_dir):
    """Parts with fifteen lines or more from three suppliers or more."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"))
    return own.where("lines >= 15 and suppliers >= 3")


def a31_sizes(spark, sf_dir):
    """Least, median and greatest number of lines of each supplier's orders."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("l_suppkey").agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))


def o1_top(spark, sf_dir):
    """The 25 dearest orders, ties by key."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def o3_collated(spark, sf_dir):
    """Names in French order, as a rank."""
    own = table(spark, sf_dir, "politicians").select(F.regexp_replace("full_name", r"^(M\.|Mme)\s+", "").alias("name"), "party").where("party <> ''")
    return top_k(own, ["party"], [F.collate("name", "fr").asc(), F.col("name").asc()], 5)


def o4_unions(spark, sf_dir):
    """Keys of customers and suppliers by nation: all of them, and distinct nations."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    every = a.unionByName(b).groupBy("nation").agg(F.count(F.lit(1)).alias("members"))
    return every.join(a.distinct().intersect(b.distinct()), "nation", "left_semi")


def o8_first_wins(spark, sf_dir):
    """The first line of each part that was emitted, by order and line number."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


def x6_centroids(spark, sf_dir):
    """Cosine of each vector to the centroid of its label, and whether it passes the label's tenth percentile."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)))
    normed = own.select("vec_id", "label", unit(F.col("v")).alias("v"))
    means = normed.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", unit(F.transform("c", lambda s: s["x"])).alias("c"))
    scored = normed.join(F.broadcast(centre), "label")  # one vector for each label
    cosine = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rated = scored.select("vec_id", "label", F.round(cosine, 6).alias("cosine"))
    from plenaria.operators.ranks import floored, values_at

    least = values_at(rated, ["label"], "cosine", {"_t": floored(0.1)})
    return rated.join(least, "label").select("vec_id", "label", "cosine", (F.col("cosine") >= F.greatest(F.lit(0.05), F.col("_t"))).cast("int").alias("kept"))


def t26_percent(spark, sf_dir):
    """Shares of order states as French per cent."""
    own = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority"))
    return own.select("o_orderpriority", "o_orderstatus", percent_text(share, 1).alias("text"))


def f6_like(spark, sf_dir):
    """Debates that hold every word of a search, whatever its case and accents."""
    own = table(spark, sf_dir, "speeches", "sid", "debate_title", "dossier_title").dropDuplicates(["sid"])
    found = F.lit(True)
    for word in ("projet", "loi"):
        found = found & (F.coalesce(fold("debate_title").contains(word), F.lit(False)) | F.coalesce(fold("dossier_title").contains(word), F.lit(False)))
    return own.where(found).groupBy("debate_title").agg(F.count(F.lit(1)).alias("speeches"))


from plenaria.plans.base import fold_sql  # noqa: E402

def _percent_sql() -> str:
    shown = lambda p: f"(floor(pct * {10**p} + 0.5) / {10**p})"
    text = lambda v, p: f"replace(regexp_replace(regexp_replace(printf('%.{p}f', {v}), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '.', ',') || ' %'"
    cases = " ".join(f"WHEN NOT ((pct < 100 AND {shown(p)} >= 100) OR (pct > 0 AND {shown(p)} <= 0)) THEN {text(shown(p), p)}" for p in (1, 2, 3))
    return f"""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) * 100 AS pct FROM c)
        SELECT o_orderpriority, o_orderstatus, CASE {cases} ELSE {text(f"CASE WHEN {shown(3)} >= 100 THEN 99.999 ELSE 0.001 END", 3)} END AS text FROM s"""


_PERCENT = _percent_sql()
_ALL = {
    "z1_counters": (z1_counters, "SELECT user_id, event_type, count(*) AS hits, max(ts) AS last FROM events GROUP BY ALL"),
    "z2_windows": (z2_windows, """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
        w AS (SELECT user_id, ts AS window_start FROM e WHERE r = 1 UNION ALL SELECT w.user_id, (SELECT min(ts) FROM e WHERE e.user_id = w.user_id AND e.ts >= w.window_start + INTERVAL 1 HOUR) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.ts >= w.window_start + INTERVAL 1 HOUR))
        SELECT w.user_id, window_start, count(*) AS hits FROM w JOIN e ON e.user_id = w.user_id AND e.ts >= window_start AND e.ts < window_start + INTERVAL 1 HOUR GROUP BY ALL"""),
    "z3_interactions": (z3_interactions, None),
    "z4_quota": (z4_quota, "WITH c AS (SELECT user_id, greatest(sum((event_type = 'click')::INT), sum((event_type = 'view')::INT))::BIGINT AS u FROM events GROUP BY 1) SELECT user_id, least(u, 300) AS used, greatest(300 - u, 0) AS remaining FROM c"),
    "z5_daily": (z5_daily, "SELECT user_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris')::DATE::VARCHAR AS day, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    "z6_last_days": (z6_last_days, "WITH m AS (SELECT max(ts::DATE) AS d FROM events) SELECT event_type, count(*) AS all_days, sum((ts::DATE > d - 7)::INT)::BIGINT AS last_7, sum((ts::DATE > d - 1)::INT)::BIGINT AS last_1 FROM events, m GROUP BY 1"),
    "z7_cursor": (z7_cursor, "WITH c AS (SELECT user_id, max(ts) AS s FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, count(*) AS new, min(ts) AS first_new FROM events e LEFT JOIN c USING (user_id) WHERE s IS NULL OR ts > s GROUP BY 1"),
    "z8_purge": (z8_purge, "SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY 1"),
    "z9_series": (z9_series, """WITH o AS (SELECT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'), m AS (SELECT max(day) AS d FROM o), u AS (SELECT DISTINCT user_id FROM o), n AS (SELECT user_id, day, count(*) AS n FROM o GROUP BY ALL),
        e AS (SELECT user_id, (d - g::INT) AS day FROM u, m, (SELECT unnest(range(30)) AS g)) SELECT e.user_id, e.day::VARCHAR AS day, coalesce(n, 0) AS count FROM e LEFT JOIN n ON n.user_id = e.user_id AND n.day = e.day"""),
    "t27_json": (t27_json, "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, json_valid(props)::INT AS valid, 0::BIGINT AS missing FROM events"),
    "f_filters": (f_filters, """SELECT o_orderkey, length(o_orderpriority)::INTEGER AS n, CASE WHEN o_totalprice > 1000 THEN 'large' ELSE 'small' END AS size FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1999-12-31' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
        AND o_orderstatus NOT IN ('P') AND o_orderpriority LIKE '1%' AND o_orderpriority ILIKE '%urg%' AND instr(o_orderpriority, 'LOW') = 0 AND o_custkey IS DISTINCT FROM 1"""),
    "f5_semi_anti": (f5_semi_anti, "SELECT c_custkey, c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '5%')"),
    "f6_like": (f6_like, f"""WITH s AS (SELECT DISTINCT ON (sid) debate_title, coalesce({fold_sql("debate_title")}, '') AS a, coalesce({fold_sql("dossier_title")}, '') AS b FROM speeches)
        SELECT debate_title, count(*) AS speeches FROM s WHERE (contains(a, 'projet') OR contains(b, 'projet')) AND (contains(a, 'loi') OR contains(b, 'loi')) GROUP BY 1"""),
    "j2_three_way": (j2_three_way, """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""),
    "j3_left_counts": (j3_left_counts, "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "j5_composite": (j5_composite, "WITH p AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2) SELECT l.l_suppkey, count(*) AS lines, max(orders) AS most FROM lineitem l JOIN p USING (l_partkey, l_suppkey) GROUP BY 1"),
    "j6_scalar_sum": (j6_scalar_sum, "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(coalesce((SELECT sum(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey AND year(i.o_orderdate) = 1997), 0), 2) AS in_1997 FROM orders o GROUP BY o_custkey"),
    "j10_latest_order": (j10_latest_order, "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1"),
    "a1_global": (a1_global, "SELECT count(*) AS lines, round(sum(l_quantity), 2) AS quantity, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem"),
    "a2_pricing": (a2_pricing, """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL"""),
    "a4_having": (a4_having, "SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) >= 15 AND count(DISTINCT l_suppkey) >= 3"),
    "a31_sizes": (a31_sizes, "WITH p AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, min(n) AS least, median(n)::DOUBLE AS median, max(n) AS most FROM p GROUP BY 1"),
    "o1_top": (o1_top, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "o3_collated": (o3_collated, """WITH p AS (SELECT regexp_replace(full_name, '^(M\\.|Mme)\\s+', '') AS name, party FROM politicians WHERE party <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY lower(strip_accents(name)), name)::INTEGER AS rank_no FROM p) SELECT * FROM r WHERE rank_no <= 5"""),
    "o4_unions": (o4_unions, "WITH a AS (SELECT c_nationkey AS nation FROM customer), b AS (SELECT s_nationkey AS nation FROM supplier) SELECT nation, count(*) AS members FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE nation IN (SELECT nation FROM a INTERSECT SELECT nation FROM b) GROUP BY 1"),
    "o8_first_wins": (o8_first_wins, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM r WHERE r = 1"),
    "t26_percent": (t26_percent, _PERCENT),
    "x6_centroids": (x6_centroids, """WITH n AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), x AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM n),
        m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT vec_id, label, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS cosine FROM n JOIN c USING (label)),
        t AS (SELECT label, list_sort(list(cosine)) AS l FROM s GROUP BY 1) SELECT vec_id, label, cosine, (cosine >= greatest(0.05, l[least(floor(0.1 * len(l))::INT, len(l) - 1) + 1]))::INT AS kept FROM s JOIN t USING (label)"""),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
