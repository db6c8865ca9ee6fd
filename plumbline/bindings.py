"""Domain relations over the Parquet tables, for queries and their SQL.

The tables hold no measurement records, so every relation is a deterministic
projection of one. SQL has each of them once more, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.taxonomy import DOMAINS


#: Added to some verdicts' task ids, so that no task has them.
STRAY = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, tier, domain, sme_minutes) from documents."""
    d = table(spark, sf_dir, "documents")
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.substring("source", 4, 9).cast("int") % 8 + 1))
    return d.select(
        F.col("doc_id").alias("task_id"),
        F.concat(F.lit("T"), (F.col("doc_id") % 6 + 1).cast("string")).alias("tier"),
        domain.alias("domain"),
        F.when(F.col("doc_id") % 4 == 0, (F.col("n_chars") % 240).cast("double")).alias("sme_minutes"),
    )


def verdict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, task_id, verdict, executed): a file for each label, some for tasks that aren't in the bank, and an older one for every seventh."""
    v = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "PASS").when(F.col("quality") == 1, "SKIP").when(F.col("toxic") == 0, "FAIL").otherwise("ERROR")
    name = F.when(F.col("doc_id") % 11 == 3, F.col("doc_id") + STRAY).otherwise(F.col("doc_id"))
    base = table(spark, sf_dir, "labels").select(name.alias("doc_id"), v.alias("verdict"))
    row = lambda d, verdict, executed: (F.concat(F.lit(d), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("doc_id").alias("task_id"), verdict.alias("verdict"), executed.alias("executed"))
    now = base.select(*row("b/", F.col("verdict"), F.col("verdict").isin("PASS", "FAIL") & (F.col("doc_id") % 13 != 5)))
    old = base.where("doc_id % 7 = 0").select(*row("a/", F.lit("ERROR"), F.lit(False)))
    return now.unionByName(old)


def oracle_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, ord, oracle, verdict, reason): five oracles for each label."""
    each = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ord"))
    code = (F.col("task_id") * 7 + F.col("ord") * 3) % 10
    verdict = F.when(code < 6, "PASS").when(code == 6, "FAIL").when(code < 9, "SKIP").otherwise("ERROR")
    reason = F.when(code == 6, "mismatch on shape").when(code == 7, "no device: gpu missing").when(code == 8, "not applicable").when(code == 9, "timeout: 300 s")
    return each.select("task_id", "ord", F.concat(F.lit("O"), F.col("ord").cast("string")).alias("oracle"), verdict.alias("verdict"), reason.alias("reason"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, n, c): attempts and successes by user; every fifth user mostly succeeds."""
    ok = (F.col("event_type") == "purchase") | ((F.col("user_id") % 5 == 0) & (F.col("event_type") != "error")) | ((F.col("user_id") % 5 == 1) & (F.col("event_id") % 2 == 0))
    ok = F.when(F.col("user_id") % 23 == 7, False).otherwise(ok)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n"), F.count_if(ok).alias("c"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(criterion, unit, rater, value): lines of an order rate it by quantity; of every fourth order only the first line has a value."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    r = table(spark, sf_dir, "lineitem").withColumn("rater", F.row_number().over(w))
    value = F.ceil(F.col("l_quantity") / 10).cast("double")
    close = F.least(F.lit(5.0), F.greatest(F.lit(1.0), (F.col("l_orderkey") % 5 + 1).cast("double") + F.when(F.col("l_partkey") % 7 == 0, 1.0).otherwise(0.0)))
    return r.select(
        F.concat(F.lit("C"), (F.col("l_orderkey") % 4).cast("string")).alias("criterion"),
        F.col("l_orderkey").alias("unit"),
        "rater",
        F.when(F.col("l_orderkey") % 4 == 0, 3.0).when(F.col("l_orderkey") % 4 == 1, close).when((F.col("l_orderkey") % 4 == 2) | (F.col("rater") == 1), value).alias("value"),
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(criterion, t, x): event values in [0, 1] by user group, in order of time."""
    group = F.concat(F.lit("G"), (F.col("user_id") % 40).cast("string"))
    t = F.row_number().over(Window.partitionBy("criterion").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(group.alias("criterion"), "ts", "event_id", F.least(F.abs("value") / 100, F.lit(1.0)).alias("x")).select("criterion", t.alias("t"), "x")


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape, side, rep, seconds): event values as times; shape by user, side by event id; one shape's baseline is slow."""
    side = F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("candidate")
    factor = F.when((F.col("event_id") % 2 == 0) & (F.col("user_id") % 6 == 0), 3.0).otherwise(1.0)
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")).alias("shape"), side.alias("side"), "event_id", ((F.abs("value") + 1) * factor / 1000).alias("seconds"))
    return e.select("shape", "side", F.row_number().over(Window.partitionBy("shape", "side").orderBy("event_id")).alias("rep"), "seconds")


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, idx, ref, cand): embeddings and a rounded copy with a few faults."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "v"))
    ref = F.col("v").cast("double")
    cand = F.when((F.col("vec_id") % 50 == 7) & (F.col("idx") == 3), F.lit(float("nan"))).when((F.col("vec_id") % 20 == 4) & (F.col("idx") % 16 == 0), ref + 0.01).otherwise(F.floor(ref * 65536 + 0.5) / 65536)
    missing = (F.col("vec_id") % 100 == 9) & (F.col("idx") == 63)
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.col("idx").cast("long").alias("idx"), ref.alias("ref"), F.when(~missing, cand).alias("cand"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, m, n, k) of matrix products, from parts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 300 + 1).alias("m"), (F.col("p_size") * 7 % 257 + 1).cast("long").alias("n"), (F.col("p_partkey") * 13 % 129 + 1).alias("k"))


_DOMAIN_LIST = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"

#: The same relations in DuckDB's SQL.
SQL = {
    "tasks": f"""SELECT doc_id AS task_id, 'T' || (doc_id % 6 + 1) AS tier, {_DOMAIN_LIST}[CAST(substr(source, 4) AS INT) % 8 + 1] AS domain,
        CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars % 240 AS DOUBLE) END AS sme_minutes FROM documents""",
    "labelled": f"""SELECT CASE WHEN doc_id % 11 = 3 THEN doc_id + {STRAY} ELSE doc_id END AS doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' WHEN quality = 1 THEN 'SKIP' WHEN toxic = 0 THEN 'FAIL' ELSE 'ERROR' END AS verdict FROM labels""",
    "verdict_files": """SELECT 'b/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, doc_id AS task_id, verdict, verdict IN ('PASS', 'FAIL') AND doc_id % 13 <> 5 AS executed FROM labelled
        UNION ALL SELECT 'a/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), doc_id, 'ERROR', false FROM labelled WHERE doc_id % 7 = 0""",
    "verdicts": """SELECT task_id, verdict, executed FROM verdict_files QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY path DESC) = 1""",
    "universe": """SELECT coalesce(t.task_id, v.task_id) AS task_id, t.task_id IS NOT NULL AS has_task, tier, domain, sme_minutes, verdict, executed FROM tasks t FULL JOIN verdicts v ON t.task_id = v.task_id""",
    "oracle_results": """SELECT task_id, ord, 'O' || ord AS oracle, CASE WHEN code < 6 THEN 'PASS' WHEN code = 6 THEN 'FAIL' WHEN code < 9 THEN 'SKIP' ELSE 'ERROR' END AS verdict,
        CASE code WHEN 6 THEN 'mismatch on shape' WHEN 7 THEN 'no device: gpu missing' WHEN 8 THEN 'not applicable' WHEN 9 THEN 'timeout: 300 s' END AS reason
        FROM (SELECT doc_id AS task_id, ord, (doc_id * 7 + ord * 3) % 10 AS code FROM labels, (SELECT unnest(range(1, 6)) AS ord))""",
    "attempts": """SELECT user_id AS item, count(*) AS n, count(*) FILTER (user_id % 23 <> 7 AND (event_type = 'purchase' OR (user_id % 5 = 0 AND event_type <> 'error') OR (user_id % 5 = 1 AND event_id % 2 = 0))) AS c FROM events GROUP BY user_id""",
    "ratings": """SELECT criterion, unit, rater, CASE WHEN unit % 4 <> 3 OR rater = 1 THEN value END AS value FROM (SELECT 'C' || (l_orderkey % 4) AS criterion, l_orderkey AS unit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rater,
        CASE l_orderkey % 4 WHEN 0 THEN 3e0 WHEN 1 THEN least(5e0, greatest(1e0, l_orderkey % 5 + 1 + CASE WHEN l_partkey % 7 = 0 THEN 1e0 ELSE 0e0 END)) ELSE CAST(ceil(l_quantity / 10) AS DOUBLE) END AS value FROM lineitem)""",
    "stream": """SELECT 'G' || (user_id % 40) AS criterion, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS t, least(abs(value) / 100, 1e0) AS x FROM events""",
    "timings": """SELECT shape, side, row_number() OVER (PARTITION BY shape, side ORDER BY event_id) AS rep, (abs(value) + 1) * f / 1000 AS seconds
        FROM (SELECT *, 's' || (user_id % 6) AS shape, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS side, CASE WHEN event_id % 2 = 0 AND user_id % 6 = 0 THEN 3e0 ELSE 1e0 END AS f FROM events)""",
    "tensors": """SELECT name, idx, ref, CASE WHEN vec_id % 100 = 9 AND idx = 63 THEN NULL WHEN vec_id % 50 = 7 AND idx = 3 THEN 'nan'::DOUBLE WHEN vec_id % 20 = 4 AND idx % 16 = 0 THEN ref + 1e-2 ELSE floor(ref * 65536 + 5e-1) / 65536 END AS cand
        FROM (SELECT vec_id, 'v' || vec_id AS name, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS ref FROM embeddings)""",
    "problems": """SELECT p_partkey AS id, p_partkey % 300 + 1 AS m, CAST(p_size * 7 % 257 + 1 AS BIGINT) AS n, p_partkey * 13 % 129 + 1 AS k FROM part""",
}
_NEEDS = {"verdict_files": ["labelled"], "verdicts": ["verdict_files"], "universe": ["tasks", "verdicts"]}


def sql(names: str, body: str) -> str:
    """body behind the named relations (blank-separated) and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + (", " + body[5:] if body.startswith("WITH ") else body)
