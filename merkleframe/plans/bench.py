"""Benchmark analytics over line items: grouped percentiles, repeats, comparisons and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from merkleframe.operators import bench as O
from merkleframe.plans.base import Plans
from merkleframe.session import table

P = Plans()
query = P.query
QUERIES, ORACLE = P.queries, P.oracle

#: Observations: identity (corpus, cache, operation, implementation), run, status and metrics.
OBS = """(SELECT l_returnflag AS corpus, l_linestatus AS cache, CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'sync' END AS operation, 'i' || (l_suppkey % 4) AS implementation,
year(l_shipdate)::INT AS run, l_discount < 0.1 AS ok, l_extendedprice AS seconds, l_quantity AS bytes, l_linenumber AS steps FROM lineitem)"""
ID = ["corpus", "cache", "operation", "implementation"]
SQL_ID = ", ".join(ID)


def observations(spark, d):
    op = F.when(F.col("l_linenumber") % 3 == 0, "read").when(F.col("l_linenumber") % 3 == 1, "write").otherwise("sync")
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("corpus"), F.col("l_linestatus").alias("cache"), op.alias("operation"), F.concat(F.lit("i"), F.col("l_suppkey") % 4).alias("implementation"),
        F.year("l_shipdate").alias("run"), (F.col("l_discount") < 0.1).alias("ok"), F.col("l_extendedprice").alias("seconds"), F.col("l_quantity").alias("bytes"), F.col("l_linenumber").alias("steps"),
    )


@query(f"SELECT {SQL_ID}, count(*)::BIGINT AS samples, quantile_disc(seconds, 0.5) AS median, quantile_disc(seconds, 0.95) AS p95, min(seconds) AS least, max(seconds) AS most FROM {OBS} WHERE ok GROUP BY {SQL_ID}")
def bench_aggregates(spark, d):
    return O.aggregates(observations(spark, d).where("ok"), ID, "seconds")


SQL_LONG = f"(SELECT {SQL_ID}, run, ok, 'seconds' AS metric, seconds AS value FROM {OBS} UNION ALL SELECT {SQL_ID}, run, ok, 'p95_bytes', CASE WHEN operation = 'sync' AND run % 2 = 0 THEN NULL ELSE bytes END FROM {OBS})"


def long_metrics(spark, d):
    o = observations(spark, d)
    bytes_ = F.when(~((F.col("operation") == "sync") & (F.col("run") % 2 == 0)), F.col("bytes"))
    return O.melt(o, [*ID, "run", "ok"], {"seconds": F.col("seconds"), "p95_bytes": bytes_})


@query(f"""SELECT {SQL_ID}, metric, count(*)::BIGINT AS repeats, CASE WHEN metric LIKE 'p95_%' THEN quantile_disc(value, 0.95) ELSE round(median(value), 9) END AS value
FROM {SQL_LONG} WHERE ok GROUP BY {SQL_ID}, metric HAVING count(value) = count(*)""")
def bench_coalesce(spark, d):
    return O.coalesce_repeats(long_metrics(spark, d).where("ok"), ID)


def sql_run(metric: str) -> str:
    return f"(SELECT {SQL_ID}, run, median({metric})::DOUBLE AS value, bool_and(seconds > 0 AND NOT (operation = 'sync' AND implementation = 'i3' AND run % 2 = 1)) AS ok FROM {OBS} GROUP BY {SQL_ID}, run)"


SQL_RUN = sql_run("seconds")


def runs(spark, d, metric="seconds"):
    o = observations(spark, d)
    fine = (F.col("seconds") > 0) & ~((F.col("operation") == "sync") & (F.col("implementation") == "i3") & (F.col("run") % 2 == 1))
    return o.groupBy(*ID, "run").agg(F.median(metric).alias("value"), F.bool_and(fine).alias("ok"))


BASE, HEAD = 1996, 1997


def _sql_outcomes(metric: str) -> str:
    return f"""SELECT '{metric}' AS metric, outcome, count(*)::BIGINT AS n FROM (
SELECT CASE WHEN h.run IS NULL THEN 'base only' WHEN b.run IS NULL THEN 'head only' WHEN NOT b.ok OR NOT h.ok THEN 'skipped' WHEN h.value = b.value THEN 'unchanged' WHEN h.value > b.value THEN 'increased' ELSE 'decreased' END AS outcome
FROM (SELECT * FROM {sql_run(metric)} WHERE run = {BASE} AND operation <> 'read') b FULL JOIN (SELECT * FROM {sql_run(metric)} WHERE run = {HEAD} AND operation <> 'write') h USING ({SQL_ID})) GROUP BY outcome"""


@query(f"{_sql_outcomes('seconds')} UNION ALL {_sql_outcomes('steps')}")
def bench_compare(spark, d):
    out = []
    for metric in ("seconds", "steps"):
        r = runs(spark, d, metric)
        c = O.compare(r.where(f"run = {BASE} AND operation <> 'read'"), r.where(f"run = {HEAD} AND operation <> 'write'"), ID)
        out.append(c.groupBy(F.lit(metric).alias("metric"), "outcome").agg(F.count("*").alias("n")))
    return out[0].union(out[1])


@query(f"""WITH r AS (SELECT * FROM {SQL_RUN} WHERE ok), first AS (SELECT {SQL_ID}, arg_min(value, run) AS baseline FROM r GROUP BY {SQL_ID})
SELECT r.corpus, r.cache, r.operation, r.implementation, r.run, round(r.value, 6) AS value, round(p.value, 6) AS previous,
CASE WHEN p.value <> 0 THEN round((r.value - p.value) / abs(p.value) * 100, 6) END AS change, CASE WHEN baseline <> 0 THEN round((r.value - baseline) / abs(baseline) * 100, 6) END AS change_from_baseline
FROM r JOIN first USING ({SQL_ID}) LEFT JOIN r p ON p.corpus = r.corpus AND p.cache = r.cache AND p.operation = r.operation AND p.implementation = r.implementation AND p.run = r.run - 1""")
def bench_revision_series(spark, d):
    return O.revision_series(runs(spark, d).where("ok"), ID)


@query("""SELECT name, median(value)::DOUBLE AS median, count(*)::BIGINT AS n FROM (SELECT unnest(json_keys(props)) AS name, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || name)::DOUBLE AS value) GROUP BY name""")
def bench_flatten_metrics(spark, d):
    return O.flatten_metrics(table(spark, d, "events"), "props")


@query("""SELECT l_shipmode_ AS strategy, sum(l_quantity)::DOUBLE AS total_bytes, max(l_quantity) AS peak, count(*)::BIGINT AS n FROM (SELECT *, 's' || (l_suppkey % 5) AS l_shipmode_ FROM lineitem) GROUP BY 1""")
def strategy_totals(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("strategy")).agg(F.sum("l_quantity").alias("total_bytes"), F.max("l_quantity").alias("peak"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT p_partkey, p_name AS name, p_brand || p_size AS pkg FROM part), r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '-2' ELSE p_name END AS name, p_brand || p_size AS pkg FROM part WHERE p_partkey % 7 <> 0),
rn AS (SELECT name, min(p_partkey) AS rk FROM r GROUP BY name), rp AS (SELECT pkg, min(p_partkey) AS rk FROM r GROUP BY pkg HAVING count(*) = 1)
SELECT CASE WHEN rn.rk IS NOT NULL THEN 'name' WHEN rp.rk IS NOT NULL THEN 'package' ELSE 'unpaired' END AS category, count(*)::BIGINT AS n FROM l LEFT JOIN rn USING (name) LEFT JOIN rp USING (pkg) GROUP BY 1""")
def fallback_pairing(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat("p_brand", "p_size").alias("pkg"))
    right = part.where("p_partkey % 7 <> 0").withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.concat("name", F.lit("-2"))).otherwise(F.col("name")))
    return O.fallback_pairs(part, right, "name", "pkg", "p_partkey").groupBy("category").agg(F.count("*").alias("n"))


@query(f"""SELECT '{{' || string_agg('"' || metric || '":{{"value":' || n || '}}', ',' ORDER BY metric) || '}}' AS document, name FROM (
SELECT corpus || '/' || operation AS name, metric, count(*) AS n FROM {SQL_LONG} WHERE ok AND value IS NOT NULL GROUP BY ALL) GROUP BY name""")
def bench_export_json(spark, d):
    m = long_metrics(spark, d).where("ok AND value IS NOT NULL").groupBy(F.concat_ws("/", "corpus", "operation").alias("name"), "metric").agg(F.count("*").alias("value"))
    return O.export_json(m)


@query(f"""SELECT corpus, operation, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END)::BIGINT AS slow, sum(CASE WHEN bytes < 5 THEN 1 ELSE 0 END)::BIGINT AS small FROM {OBS} WHERE NOT ok OR bytes < 5 GROUP BY ALL""")
def sample_failures(spark, d):
    f = O.failures(observations(spark, d), {"slow": ~F.col("ok"), "small": F.col("bytes") < 5})
    return f.groupBy("corpus", "operation").agg(F.count(F.when(F.col("failure") == "slow", 1)).alias("slow"), F.count(F.when(F.col("failure") == "small", 1)).alias("small"))


@query("SELECT l_orderkey % 10 AS archive, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS files, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS links, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)::DOUBLE AS bytes FROM lineitem GROUP BY 1")
def entry_kind_report(spark, d):
    o = F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 10).alias("archive")).agg(F.count(F.when(o, 1)).alias("files"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("links"), F.sum(F.when(o, F.col("l_quantity")).otherwise(0.0)).alias("bytes"))


@query("""WITH n AS (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS k, n_regionkey FROM nation), r AS (SELECT unnest(range(0, 3)) AS repetition)
SELECT n_regionkey AS corpus, repetition::INT AS repetition, ((i - repetition % k + k) % k)::INT AS place, n_name AS name FROM n, r""")
def balanced_jobs(spark, d):
    return O.balanced_jobs(table(spark, d, "nation").select(F.col("n_regionkey").alias("corpus"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")), 3)


@query("""SELECT sha256(string_agg(n_nationkey || ':' || n_name || ':' || n_regionkey, chr(10) ORDER BY n_name)) AS identity, count(*)::BIGINT AS entries FROM nation""")
def tree_manifest_identity(spark, d):
    line = F.concat_ws(":", "n_nationkey", "n_name", "n_regionkey")
    return table(spark, d, "nation").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("identity"), F.count("*").alias("entries"))


@query("SELECT o_custkey % 100 AS root, count(*)::BIGINT AS objects FROM orders GROUP BY 1")
def object_count(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("root")).agg(F.count("*").alias("objects"))

