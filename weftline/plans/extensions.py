"""What Spark brings beyond the catalogue: join kinds, grouping sets, window families, recursion, functions, vectors."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.plans._util import r, rounded, t
from weftline.tables import small_enough


def _views(spark: SparkSession, d: str, *names: str) -> None:
    for n in names:
        t(spark, d, n).createOrReplaceTempView(n)


_JOIN = "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


@query("ext_join_strategies", "EXT01", sql=_JOIN)
def ext_join_strategies(spark: SparkSession, d: str) -> DataFrame:
    """A small side is broadcast if the optimizer proves it small; the large sides meet by a hash of the key."""
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    n = F.broadcast(n) if small_enough(n) else n
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = t(spark, d, "orders").select("o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))  # pre-aggregated before the join
    j = o.hint("shuffle_hash").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.sum("k").alias("n"), r(F.sum("s"), 2).alias("total"))


@query("ext_interval_join", "EXT02", sql="""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts""")  # fmt: skip
def ext_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Clicks in the half hour before a purchase: both sides are cut into half-hour bins, a purchase looks into two of them."""
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).alias("bin"))
    a = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("at"), F.explode(F.array(F.col("bin") - 1, F.col("bin"))).alias("bin"))
    b = e.filter("event_type = 'click'").select(F.col("event_id").alias("b"), "user_id", F.col("ts").alias("bt"), "bin")
    j = a.join(b, ["user_id", "bin"])
    return j.filter((F.col("bt") <= F.col("at")) & (F.col("bt") >= F.col("at") - F.expr("interval 30 minutes"))).select("a", "b")


@query("ext_asof", "EXT03", sql="""
SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""")  # fmt: skip
def ext_asof(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.series import asof

    e = t(spark, d, "events")
    a = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.filter("event_type = 'click'").select("user_id", "ts", "value")
    return asof(a, b, ["user_id"], "ts", "value").select("event_id", "asof_value")


@query("ext_null_safe_join", "EXT04", sql="""
WITH a AS (SELECT DISTINCT archive_key FROM papyri_documents), b AS (SELECT archive_key, count(*) AS n FROM canonical_persons GROUP BY 1)
SELECT a.archive_key AS a, b.archive_key AS b, n FROM a FULL JOIN b ON a.archive_key IS NOT DISTINCT FROM b.archive_key AND n > 2""")  # fmt: skip
def ext_null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "papyri_documents").select(F.col("archive_key").alias("a")).distinct()
    b = t(spark, d, "canonical_persons").groupBy(F.col("archive_key").alias("b")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("a").eqNullSafe(F.col("b")) & (F.col("n") > 2), "full_outer")


@query("ext_right_join", "EXT04", sql="""
SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 0) RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 10""")  # fmt: skip
def ext_right_join(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").filter("n_nationkey % 2 = 0")
    return n.join(t(spark, d, "region"), (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_nationkey") > 10), "right_outer").select("n_name", "r_name")


@query("ext_rollup", "EXT05", sql="""
SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS gid, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")  # fmt: skip
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("ext_cube", "EXT05", sql="""
SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")  # fmt: skip
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("ext_grouping_sets", "EXT05", sql="""
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")  # fmt: skip
def ext_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ext_distinct_filter", "EXT06", sql="""
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1""")  # fmt: skip
def ext_distinct_filter(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("discounted")
    )


@query("ext_approximate", "EXT07", sql="""
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, round(median(l_extendedprice), 3)::DOUBLE AS median, true AS orders_near, true AS median_near FROM lineitem GROUP BY 1""")  # fmt: skip
def ext_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Exact figures and whether their sketches come near: distinct orders within a tenth, median price within a hundredth."""
    g = t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.countDistinct("l_orderkey").alias("orders"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("b"), r(F.median("l_extendedprice"), 3).alias("median")
    )
    near = lambda x, y, e: F.abs(F.col(x) / F.col(y) - 1) < e
    return g.select("l_returnflag", "orders", "median", near("a", "orders", 0.1).alias("orders_near"), near("b", "median", 0.01).alias("median_near"))


@query("ext_moments", "EXT08", sql="""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_orderstatus, arg_min(o_orderpriority, (-n, o_orderpriority)) AS m, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS listed FROM c GROUP BY 1)
SELECT o.o_orderstatus, round(kurtosis_pop(o_totalprice), 4) AS kurt, round(skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 4)::DOUBLE AS skew, any_value(m) AS m, any_value(listed) AS listed, round(var_samp(o_totalprice) / 1e6, 3) AS var
FROM orders o JOIN m USING (o_orderstatus) GROUP BY 1""")  # fmt: skip
def ext_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments, the commonest value (the first in order of several) and the list of values of each group."""
    g = t(spark, d, "orders").groupBy("o_orderstatus")
    m = g.agg(r(F.kurtosis("o_totalprice"), 4).alias("kurt"), r(F.skewness("o_totalprice"), 4).alias("skew"), F.mode("o_orderpriority", deterministic=True).alias("m"), r(F.var_samp("o_totalprice") / 1e6, 3).alias("var"))
    kinds = t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    kinds.createOrReplaceTempView("ext_kinds")
    listed = spark.sql("SELECT o_orderstatus, listagg(o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority) AS listed FROM ext_kinds GROUP BY 1")
    return m.join(listed, "o_orderstatus")


@query("ext_rank_family", "EXT10", sql="""
SELECT c_custkey, rank() OVER w::INTEGER AS rk, dense_rank() OVER w::INTEGER AS drk, round(percent_rank() OVER w, 6) AS prk, round(cume_dist() OVER w, 6) AS cd,
  nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")  # fmt: skip
def ext_rank_family(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    u = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t(spark, d, "customer").select(
        "c_custkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("drk"), r(F.percent_rank().over(w)).alias("prk"), r(F.cume_dist().over(w)).alias("cd"), F.nth_value("c_custkey", 2).over(u).alias("second")
    )


@query("ext_moving_average", "EXT11", sql="""
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 5) AS ma,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""")  # fmt: skip
def ext_moving_average(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d, "events")
    return spark.sql("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 5) AS ma,
      count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""")


@query("ext_bag_operations", "EXT12", sql="""
SELECT 'intersect' AS kind, k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09) GROUP BY ALL UNION ALL
SELECT 'except', k, count(*) FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09) GROUP BY ALL""")  # fmt: skip
def ext_bag_operations(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    a, b = li.filter("l_quantity > 49").select(F.col("l_suppkey").alias("k")), li.filter("l_discount > 0.09").select(F.col("l_suppkey").alias("k"))
    count = lambda df, n: df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "k", "n")
    return count(a.intersectAll(b), "intersect").unionByName(count(a.exceptAll(b), "except"))


_SUB = """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)"""


@query("ext_subqueries", "EXT13", sql=_SUB)
def ext_subqueries(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d, "customer", "orders", "nation")
    return spark.sql(_SUB)


_RECURSIVE = """WITH RECURSIVE w(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM w WHERE n < 20) SELECT n, f FROM w"""


@query("ext_recursion", "EXT14", sql=_RECURSIVE)
def ext_recursion(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_RECURSIVE)


@query("ext_variant", "EXT15", sql="SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def ext_variant(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("ext_user_functions", "EXT18", sql="""
WITH e AS (SELECT event_type, (value - 50) / 10 AS v FROM events), q AS (SELECT event_type, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM e GROUP BY 1),
m AS (SELECT event_type, round(avg(v), 6) AS tm FROM e JOIN q USING (event_type) WHERE v BETWEEN lo AND hi GROUP BY 1)
SELECT event_type, tm, unnest([left(event_type, length(event_type) // 2), substr(event_type, length(event_type) // 2 + 1)]) AS part FROM m""")  # fmt: skip
def ext_user_functions(spark: SparkSession, d: str) -> DataFrame:
    """A scalar and an aggregating function over Arrow batches and a table function, side by side."""

    @F.pandas_udf("double")
    def scaled(x: pd.Series) -> pd.Series:
        return (x - 50.0) / 10.0

    @F.pandas_udf("double")
    def trimmed_mean(x: pd.Series) -> float:
        lo, hi = x.quantile(0.1), x.quantile(0.9)
        return float(x[(x >= lo) & (x <= hi)].mean())

    @F.udtf(returnType="part string")
    class Halves:
        def eval(self, word: str) -> Iterator[tuple]:
            yield (word[: len(word) // 2],)
            yield (word[len(word) // 2 :],)

    spark.udtf.register("halves", Halves)
    e = t(spark, d, "events").select("event_type", scaled("value").alias("v"))
    e.groupBy("event_type").agg(trimmed_mean("v").alias("tm")).createOrReplaceTempView("ext_trimmed")
    return spark.sql("SELECT event_type, round(tm, 6) AS tm, part FROM ext_trimmed, LATERAL halves(event_type)")


@query("ext_connectors", "EXT19", sql="""
SELECT f AS format, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation CROSS JOIN (VALUES ('orc'), ('parquet'), ('csv'), ('json'), ('gz'), ('text')) v(f) GROUP BY 1""")  # fmt: skip
def ext_connectors(spark: SparkSession, d: str) -> DataFrame:
    """One table through every file format and back: the rows each brings home."""
    import uuid

    from weftline.session import ensure_checkpoint_dir
    from weftline.sinks import files as K
    from weftline.sources import files as S

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/formats-{uuid.uuid4().hex}"
    n = t(spark, d, "nation")
    n.write.orc(f"{base}/orc")
    n.write.parquet(f"{base}/parquet")
    K.csv_report(n, f"{base}/csv", ["n_nationkey"])
    K.append_jsonl(n, f"{base}/json")
    K.gzip_json(n, f"{base}/gz")
    schema = "n_nationkey int, n_name string, n_regionkey int"
    back = {
        "orc": spark.read.orc(f"{base}/orc"), "parquet": spark.read.parquet(f"{base}/parquet"), "csv": S.csv_table(spark, f"{base}/csv", schema),
        "json": S.jsonl(spark, f"{base}/json", schema, "n_nationkey"), "gz": spark.read.schema(schema).json(f"{base}/gz"), "text": S.csv_text(spark, f"{base}/csv").select("n_nationkey", "n_name", "n_regionkey"),
    }
    out = None
    for k, df in back.items():
        one = df.agg(F.lit(k).alias("format"), F.count("*").alias("n"), F.sum(F.col("n_nationkey").cast("bigint")).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


@query("ext_vector_search", "EXT20", sql="""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS c FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id)::INTEGER AS rk FROM p) SELECT query_id, vec_id, rk, round(c, 6) AS cosine FROM k WHERE rk <= 5""")  # fmt: skip
def ext_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors by cosine of every vector whose id is divisible by 20, exactly, in blocks.

    Queries are collected in blocks (a stated query set); each task keeps its own five best per query before anything moves.
    """
    import numpy as np
    import pyarrow as pa

    e = t(spark, d, "embeddings").filter("embedding is not null").select("vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").orderBy("vec_id")
    block, done, k = 2000, None, 5
    total = q.count()
    for start in range(0, total, block):
        rows = q.offset(start).limit(block).collect()
        ids = np.array([x["vec_id"] for x in rows])
        mat = np.array([x["embedding"] for x in rows], dtype=np.float64)
        mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)

        def best(batches, ids=ids, mat=mat):
            for b in batches:
                v = np.stack([np.asarray(x, dtype=np.float64) for x in b.column(1).to_pylist()]) if b.num_rows else np.empty((0, mat.shape[1]))
                own = b.column(0).to_numpy()
                s = mat @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T
                s[ids[:, None] == own[None, :]] = -2.0
                m = min(k, len(own))
                if m == 0:
                    continue
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(own[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["query_id", "vec_id", "cosine"])

        part = e.mapInArrow(best, "query_id bigint, vec_id bigint, cosine double")
        done = part if done is None else done.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    return done.withColumn("rk", F.row_number().over(w)).filter("rk <= 5 and cosine > -2").select("query_id", "vec_id", "rk", r("cosine").alias("cosine"))


@query("ext_vector_index", "EXT20")
def ext_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20, through an index over all rows."""
    from weftline.operators.vectors import search_index

    e = t(spark, d, "embeddings")
    got = search_index(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding")
    return got.select("query_id", F.col("id").alias("vec_id"), "rk", r("cosine").alias("cosine"))


@query("ext_vector_recall", "EXT20", sql="SELECT count(*) * 5 AS sought, true AS enough FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 20 = 0")
def ext_vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """How much of the exact search the index finds: at least nine tenths."""
    exact, index = ext_vector_search(spark, d).select("query_id", "vec_id"), ext_vector_index(spark, d).select("query_id", "vec_id", F.lit(1).alias("hit"))
    got = exact.join(index, ["query_id", "vec_id"], "left").agg(F.count("*").alias("sought"), F.count("hit").alias("found"))
    return got.select("sought", (F.col("found") >= 0.9 * F.col("sought")).alias("enough"))
