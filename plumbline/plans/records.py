"""Registered queries of record decoders, user checks and hashes, and their SQL.

The files that the decoders read are texts made from the tables, some of them faulty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions.hashing import stable_hash
from plumbline.operators import checks as C
from plumbline.sources import records as S

_each = lambda n, k: F.col("task_id") % n == k


def _task_texts(s, d):
    """A YAML text for each document, with seven kinds of fault."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    t = B.tasks(s, d)
    body = F.concat(
        F.when(_each(23, 5), "").otherwise(line("task_id", F.concat(F.lit("t"), "task_id"))),
        F.lit("created_utc: '2026-01-01T00:00:00+00:00'\nseed_source: {seed_id: s, module: m, entry: e, content_sha256: x}\nmutation: {cls: dtype, site: here, params: {a: 1}, description: d}\n"),
        F.lit("baseline_code: b\nmutant_code: m\nground_truth_diff: d\ndetect_shapes: [{name: wide_1, kwargs: {m: 4}}]\n"),
        line("domain", F.when(_each(37, 8), "nowhere").otherwise(F.col("domain"))),
        line("failure_tier", F.when(_each(17, 3), "T9").otherwise(F.col("tier"))),
        line("prompt", F.when(_each(29, 6), "see wide_1").otherwise("find it")),
        F.when(_each(19, 4), "more: 1\n").otherwise(""),
    )
    text = F.when(_each(31, 7), "- 1\n").otherwise(body)
    return t.select(F.col("task_id").cast("string").alias("path"), text.alias("text"))


def _tasks(s, d):
    got = S.decode_tasks(_task_texts(s, d))
    ok = lambda c: F.when(F.col("error").isNull(), F.col(c))
    shape = F.col("detect_shapes")[0]
    return got.select("path", "error", *[ok(c).alias(c) for c in ("task_id", "domain", "failure_tier")], F.when(F.col("error").isNull(), shape["name"]).alias("shape"))


def _verdict_texts(s, d):
    """A JSON text for each verdict file, with four kinds of fault."""
    v = B.verdict_files(s, d)
    result = F.struct(F.lit("O1").alias("oracle"), "verdict", F.when((F.col("verdict") != "PASS") & ~_each(5, 2), "because").alias("reason"))
    whole = F.to_json(F.struct(F.col("task_id").cast("string").alias("task_id"), F.when(_each(9, 4), "OK").otherwise(F.col("verdict")).alias("verdict"), F.when(~_each(14, 9), F.col("executed")).alias("executed"), F.array(result).alias("oracle_results")))
    return v.select("path", F.when(_each(10, 6), "{").otherwise(whole).alias("text"))


def _verdicts(s, d):
    got = S.decode_verdicts(_verdict_texts(s, d))
    ok = lambda c: F.when(F.col("error").isNull(), c)
    return got.select("path", "error", *[ok(F.col(c)).alias(c) for c in ("task_id", "verdict", "executed")], ok(F.col("oracle_results")[0]["reason"]).alias("reason"))


def _lines(s, d, line):
    """(path, text): a text for each order, of a line for each of its parts in order; parts that tie go by number before they go by text."""
    order = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_extendedprice", line.alias("line"))
    one = B.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("p"))
    return one.select("l_orderkey", F.array_join(F.transform("p", lambda p: p["line"]), "\n").alias("body"))


def _ratings(s, d):
    second = F.when(F.col("l_linenumber") % 2 == 0, "NA").when(F.col("l_orderkey") % 11 == 3, "x").otherwise(F.col("l_partkey").cast("string"))
    files = _lines(s, d, F.concat(F.lit("r"), F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_quantity").cast("int").cast("string"), F.lit(","), second))
    text = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "who,first,second\n\n").otherwise(""), "body")
    return S.decode_ratings(files.select(F.col("l_orderkey").cast("string").alias("path"), text.alias("text")))


def _profiles(s, d):
    value = F.when(F.col("l_partkey") % 7 == 0, "n/a").otherwise(F.format_number(F.col("l_partkey") * 10, 0))
    line = F.concat(F.lit('"k'), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, '","dram","byte","').otherwise('","time","ns","'), value, F.lit('"'))
    text = F.concat(F.lit('==PROF== of a run\n"Kernel Name","Metric Name","Metric Unit","Metric Value"\n'), "body")
    return S.decode_profiles(_lines(s, d, line).select(F.col("l_orderkey").cast("string").alias("path"), text.alias("text")))


def _upsert(s, d):
    known = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = known.where("id % 3 = 0").select(F.when(F.col("id") % 2 == 0, F.col("id") + B.STRAY).otherwise(F.col("id")).alias("id"), F.lower("name").alias("name"))
    return S.upsert(known, new)


def _written_back(s, d):
    t = B.tasks(s, d).select("task_id", F.when(_each(2, 0), "old").alias("calibration"))
    return S.with_calibration(t, t.where("task_id % 3 = 0").select("task_id", F.lit("new").alias("calibration")))


def _checks(s, d):
    known = C.Checks(
        C.Check("K1", lambda o: F.when(F.col("sme_minutes").isNull(), "FAIL").otherwise("PASS"), lambda o: F.lit("no time"), applies=lambda o: F.col("tier") != "T6"),
        C.Check("K2", lambda o: F.lit("PASS"), needs=("cpu", "gpu")),
        C.Check("K3", lambda o: F.when(F.col("sme_minutes") <= o["most"], "PASS").when(F.col("sme_minutes") > o["most"], "FAIL"), lambda o: F.when(F.col("tier") != "T1", f"over {o['most']}"), needs=("cpu",)),
    )
    t = B.tasks(s, d).withColumn("checks", F.when(_each(3, 0), F.array(F.lit("K1"), F.lit("K9"))))
    return known.run(t, {"cpu"}, {"most": 120}).select("task_id", F.col("ord").cast("long").alias("ord"), "check", "verdict", "reason")


def _graded(s, d):
    e = B.table(s, d, "events").select(F.col("user_id").alias("task_id"), "event_type", "value")
    return C.grade(e, (F.col("event_type") == "purchase") | F.when(F.col("event_type") != "error", F.col("value") > 50))


QUERIES = {
    "s03_decode_tasks": _tasks,
    "s04_decode_verdicts": _verdicts,
    "s05_decode_ratings": _ratings,
    "s07_decode_profiles": _profiles,
    "s12_upsert": _upsert,
    "s13_calibration_back": _written_back,
    "o01_checks": _checks,
    "d04_grade": _graded,
    "u05_selected": lambda s, d: C.selected(B.tasks(s, d), "tier", "T1, T4").groupBy("tier", "domain").agg(F.count("*").alias("n")),
    "f01_stable_hash": lambda s, d: B.table(s, d, "orders").select("o_orderkey", stable_hash(F.create_map(F.lit("n"), F.col("o_custkey").cast("long"), F.lit("m"), F.col("o_orderkey").cast("long"))).alias("hash")),
}

_NOT = "error IS NULL THEN"
ORACLE_SQL = {
    "s03_decode_tasks": B.sql(
        "tasks",
        f"""SELECT path, error, CASE WHEN {_NOT} 't' || path END AS task_id, CASE WHEN {_NOT} domain END AS domain, CASE WHEN {_NOT} tier END AS failure_tier, CASE WHEN {_NOT} 'wide_1' END AS shape
        FROM (SELECT *, CAST(task_id AS VARCHAR) AS path, CASE WHEN task_id % 31 = 7 THEN 'not a mapping' WHEN task_id % 19 = 4 THEN 'unknown field: more' WHEN task_id % 23 = 5 THEN 'missing field: task_id'
        WHEN task_id % 37 = 8 THEN 'unknown domain: nowhere' WHEN task_id % 17 = 3 THEN 'unknown tier: T9' WHEN task_id % 29 = 6 THEN 'the prompt names a withheld shape' END AS error FROM tasks)""",
    ),
    "s04_decode_verdicts": B.sql(
        "verdict_files",
        f"""SELECT path, error, CASE WHEN {_NOT} CAST(task_id AS VARCHAR) END AS task_id, CASE WHEN {_NOT} verdict END AS verdict, CASE WHEN {_NOT} executed END AS executed, CASE WHEN error IS NULL AND verdict <> 'PASS' THEN 'because' END AS reason
        FROM (SELECT *, CASE WHEN task_id % 10 = 6 THEN 'not a mapping' WHEN task_id % 14 = 9 THEN 'missing field: executed' WHEN task_id % 9 = 4 THEN 'unknown verdict: OK'
        WHEN verdict <> 'PASS' AND task_id % 5 = 2 THEN 'a result other than PASS has no reason' END AS error FROM verdict_files)""",
    ),
    "s05_decode_ratings": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rater FROM lineitem),
        wrong AS (SELECT l_orderkey, min(rater) AS rater FROM l WHERE l_orderkey % 11 = 3 AND l_linenumber % 2 = 1 GROUP BY l_orderkey),
        cells AS (SELECT l_orderkey, rater, 1 AS unit, 'first' AS name, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS value FROM l UNION ALL SELECT l_orderkey, rater, 2, 'second', CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_partkey AS DOUBLE) END FROM l)
        SELECT CAST(l_orderkey AS VARCHAR) AS path, NULL AS error, rater, CAST(unit AS BIGINT) AS unit, CASE WHEN l_orderkey % 2 = 0 THEN name END AS name, value FROM cells WHERE l_orderkey NOT IN (SELECT l_orderkey FROM wrong)
        UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'row ' || rater || ', column 2 is not a number', NULL, NULL, NULL, NULL FROM wrong""",
    "s07_decode_profiles": """SELECT CAST(l_orderkey AS VARCHAR) AS path, CASE WHEN l_linenumber % 2 = 0 THEN 'dram' ELSE 'time' END AS metric, CASE WHEN l_linenumber % 2 = 0 THEN 'byte' ELSE 'ns' END AS unit, count(v) AS n_kernels, min(v) AS min, max(v) AS max, avg(v) AS mean,
        count(DISTINCT CASE WHEN v IS NOT NULL THEN l_linenumber END) AS kernels, count(*) - count(v) AS unparsed FROM (SELECT *, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey * 1e1 END AS v FROM lineitem) GROUP BY ALL""",
    "s12_upsert": f"""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN lower(s_name) ELSE s_name END AS name FROM supplier
        UNION ALL SELECT s_suppkey + {B.STRAY}, lower(s_name) FROM supplier WHERE s_suppkey % 6 = 0""",
    "s13_calibration_back": "SELECT doc_id AS task_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN 'old' END AS calibration FROM documents",
    "o01_checks": B.sql(
        "tasks",
        """WITH asked AS (SELECT *, CASE WHEN task_id % 3 = 0 THEN ['K1', 'K9'] ELSE ['K1', 'K2', 'K3'] END AS c FROM tasks), rows AS (SELECT task_id, tier, sme_minutes AS m, generate_subscripts(c, 1) - 1 AS ord, unnest(c) AS "check" FROM asked)
        SELECT task_id, CAST(ord AS BIGINT) AS ord, "check", CASE "check" WHEN 'K1' THEN CASE WHEN m IS NULL THEN 'FAIL' ELSE 'PASS' END WHEN 'K2' THEN 'SKIP' WHEN 'K9' THEN 'ERROR' ELSE CASE WHEN m <= 120 THEN 'PASS' WHEN m > 120 AND tier <> 'T1' THEN 'FAIL' ELSE 'ERROR' END END AS verdict,
        CASE "check" WHEN 'K1' THEN CASE WHEN m IS NULL THEN 'no time' END WHEN 'K2' THEN 'requires cpu, gpu; missing gpu' WHEN 'K9' THEN 'check K9 is not registered; there are K1, K2, K3'
        ELSE CASE WHEN m IS NULL THEN 'no verdict: null' WHEN m > 120 AND tier = 'T1' THEN 'no reason for FAIL' WHEN m > 120 THEN 'over 120' END END AS reason FROM rows WHERE NOT ("check" = 'K1' AND tier = 'T6')""",
    ),
    "d04_grade": "SELECT user_id AS task_id, count(*) AS n, count(*) FILTER (event_type = 'purchase' OR (event_type <> 'error' AND value > 50)) AS c FROM events GROUP BY user_id",
    "u05_selected": B.sql("tasks", "SELECT tier, domain, count(*) AS n FROM tasks WHERE tier IN ('T1', 'T4') GROUP BY tier, domain"),
    "f01_stable_hash": """SELECT o_orderkey, substr(sha256('{"m":' || o_orderkey || ',"n":' || o_custkey || '}'), 1, 16) AS hash FROM orders""",
}
