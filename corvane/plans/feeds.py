"""Queries of byte streams, commit histories and versions of tables, which follow from the columns of orders, their lines and events.

A customer is a session of a language server: it opens with the first order, and every order publishes one diagnostic.  A chunk holds the second half of one frame and the
first of the next, so what an order publishes arrives with the customer's next order.  An order is also a commit, and its lines what the commit changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import latest
from corvane.plans.catalog import query, table
from corvane.session import work_folder
from corvane.shipping import tasks_for
from corvane.sources import churn, reports
from corvane.streaming import capture, frames

_SETTLE = "400 days"
#: Orders of which a task makes chunks, about: some 100 MB of text.
_ORDERS_A_TASK = 250_000


def _framed(body: Column) -> Column:
    return F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def _chunks(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """Texts are made after the sort, so that only narrow rows are shuffled; sessions stay where they were dealt to."""
    k = F.col("o_orderkey")
    level = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 3).otherwise(4)
    said = '{"jsonrpc":"2.0","method":"textDocument/publishDiagnostics","params":{"uri":"file:///w/o%d.rs","diagnostics":[{"range":{"start":{"line":%d,"character":2},"end":{"line":%d,"character":4}},"severity":%d,"code":"E%d","message":"order %d"}]}}'
    said = _framed(F.format_string(said, k % 3, k % 2, k % 2, level, k % 2, k))
    said = F.when(k % 4 == 0, F.concat(said, _framed(F.lit('{"broken')))).otherwise(said)
    orders = table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session"), F.col("o_orderdate").cast("timestamp").alias("ts"), k, "o_orderstatus")
    along = Window.partitionBy("session").orderBy("ts", "o_orderkey")
    orders = orders.repartition(tasks, "session").withColumns({"r": F.row_number().over(along).cast("long"), "end": F.lead("ts").over(along).isNull()})
    half = (F.length("said") / 2).cast("int")
    orders = orders.select("session", "ts", k, "r", "end", said.alias("said")).select("session", "ts", k, "r", "end", F.substr("said", F.lit(1), half).alias("a"), F.substr("said", half + 1).alias("b"))
    opening = _framed(F.lit('{"jsonrpc":"2.0","id":1,"result":{}}'))
    orders = orders.withColumn("before", F.coalesce(F.lag("b").over(along), opening))
    own = F.struct((F.col("r") - 1).alias("seq"), F.concat("before", "a").alias("text"), F.lit(False).alias("last"))
    closing = F.struct(F.col("r").alias("seq"), F.col("b").alias("text"), F.lit(True).alias("last"))
    rows = orders.select("session", "ts", F.when(F.col("end"), F.array(own, closing)).otherwise(F.array(own)).alias("c"))
    return rows.select("session", "ts", F.inline("c")).select("session", "seq", F.encode("text", "UTF-8").alias("chunk"), "ts", "last")


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(table(spark, sf_dir, "orders"), _ORDERS_A_TASK)


_PUBLISHED = """
WITH t AS (SELECT 's' || o_custkey AS session, o_orderkey AS k, o_orderdate AS d, o_orderstatus AS s, coalesce(lead(o_orderdate) OVER w, o_orderdate) AS arrives, min(o_orderdate) OVER (PARTITION BY o_custkey) AS d0
  FROM orders WHERE o_custkey IS NOT NULL WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT session, 'o' || k % 3 || '.rs' AS file, (k % 2)::INT AS line, 'E' || k % 2 AS code, CASE s WHEN 'F' THEN 'error' WHEN 'O' THEN 'info' ELSE 'hint' END AS severity, 'order ' || k AS message
FROM t WHERE arrives < d0 + INTERVAL 400 DAY QUALIFY row_number() OVER (PARTITION BY session, k % 3, k % 2 ORDER BY d DESC, k DESC) = 1
"""


def _diagnostics(entries: DataFrame) -> DataFrame:
    found = reports.rust_analyzer(entries, root="/w", session="session", at=("n", "k"))
    return found.select("session", "file", F.col("range.start.line").alias("line"), "code", "severity", "message")


@query(_PUBLISHED)
def q_session_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    return _diagnostics(frames.published(_chunks(spark, sf_dir, tasks), _SETTLE, tasks=tasks))


@query(_PUBLISHED)
def q_session_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream in two runs: chunks of the first years, and then also those of the others."""
    folder, chunks = work_folder(spark), _chunks(spark, sf_dir, _tasks(spark, sf_dir))
    late = F.year("ts") >= 1998
    old = {k: spark.conf.get(k, None) for k in frames.STORE}
    try:
        for k, v in frames.STORE.items():
            spark.conf.set(k, v)
        for part in (chunks.filter(~late), chunks.filter(late)):
            part.write.mode("append").parquet(f"{folder}/chunks")
            entries = frames.settled(spark.readStream.schema(frames.CHUNKS).parquet(f"{folder}/chunks"), _SETTLE)
            entries.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(path=f"{folder}/entries", format="parquet").awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return _diagnostics(spark.read.schema(frames.PUBLISHED).parquet(f"{folder}/entries"))


@query("""
WITH w AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders o WHERE o_orderpriority <> '5-LOW' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 10 > 1)),
c AS (SELECT k FROM w ORDER BY d DESC, k DESC LIMIT 1000)
SELECT 'src/' || l_partkey % 10 || '/p' || l_partkey || '.py' AS path, sum(l_quantity::BIGINT + l_linenumber)::BIGINT AS churn_loc FROM lineitem JOIN c ON k = l_orderkey WHERE l_linenumber <> 7 AND l_partkey % 10 > 1 GROUP BY 1
""")
def q_churn_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1,000 orders of 400 days that have a part outside the first two folders; orders of the last priority are merges, seventh lines binary files."""
    orders = table(spark, sf_dir, "orders")
    commits = orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderpriority") == "5-LOW").alias("merge"))
    part, counted = F.col("l_partkey"), F.col("l_linenumber") != 7
    path = F.concat(F.when(part % 10 > 1, "").otherwise("old/"), F.lit("src/"), (part % 10).cast("string"), F.lit("/p"), part.cast("string"), F.lit(".py"))
    diffs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), path.alias("path"), F.lit(None).cast("string").alias("old_path"), F.when(counted, F.col("l_quantity").cast("long")).alias("added"), F.when(counted, F.col("l_linenumber").cast("long")).alias("deleted"))
    as_of = commits.agg(F.max("ts")).first()[0]
    return churn.collect(commits, diffs, as_of, days=400, limit=1000, under="src/")


@query("""
WITH r AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem WHERE l_linenumber = 1), n AS (SELECT p, count(*) AS n FROM r GROUP BY 1)
SELECT 'p' || l_partkey || '.' || coalesce(n, 0) AS now, sum(l_quantity::BIGINT)::BIGINT AS loc, count(*) AS changes FROM lineitem LEFT JOIN n ON p = l_partkey GROUP BY 1
""")
def q_renames_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order that has a part in its first line gives the part's file its next name; lines count for the last name."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("seq"), F.col("l_quantity").cast("long").alias("loc"), (F.col("l_linenumber") == 1).alias("first"))
    orders = lines.groupBy("p", "seq").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("changes"), F.bool_or("first").alias("renames"))
    orders = orders.withColumn("v", F.count_if("renames").over(Window.partitionBy("p").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    name = lambda v: F.concat(F.lit("p"), F.col("p").cast("string"), F.lit("."), v.cast("string"))
    renames = orders.filter("renames").select("seq", name(F.col("v") - 1).alias("old_path"), name(F.col("v")).alias("path"))
    out = churn.moved(orders.select(name(F.col("v")).alias("path"), "seq", "loc", "changes"), renames)
    return out.groupBy("now").agg(F.sum("loc").alias("loc"), F.sum("changes").alias("changes"))


# --- versions and what changed between them ---------------------------------------------------------------------------


@query("""
WITH s AS (SELECT v, user_id, max(event_id) AS e, arg_max(event_type, event_id) AS t FROM events, (VALUES (0), (1), (2)) x(v) WHERE event_id % 3 <= v GROUP BY ALL), l AS (SELECT v, user_id, e FROM s WHERE t <> 'error')
SELECT coalesce(n.v, o.v + 1)::BIGINT AS version, 'u' || coalesce(n.user_id, o.user_id) || '.py' AS path, CASE WHEN o.v IS NULL THEN 'create' WHEN n.v IS NULL THEN 'remove' ELSE 'modify' END AS kind
FROM l n FULL JOIN (SELECT * FROM l WHERE v < 2) o ON n.v = o.v + 1 AND n.user_id = o.user_id WHERE o.e IS DISTINCT FROM n.e
""")
def q_tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files whose content is their last event, looked at three times while a third of the events is added each time; an error removes a file."""
    folder = work_folder(spark)
    for v in range(3):
        last = latest.latest_wins(table(spark, sf_dir, "events").filter(F.col("event_id") % 3 <= v).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"]).filter("event_type <> 'error'")
        capture.watch(last.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.col("event_id").cast("string").alias("blob_sha")), folder)
    return spark.read.schema(capture.CHANGES).parquet(f"{folder}/changes").select("version", "path", "kind")


@query("""
WITH o AS (SELECT 'c' || o_custkey AS file, o_orderkey AS k, o_orderkey % 10 AS m, o_orderstatus AS s, o_orderpriority AS p FROM orders),
a AS (SELECT * FROM o WHERE m <> 3), b AS (SELECT * FROM o WHERE m <> 7),
ha AS (SELECT file, count(*) AS n FROM a GROUP BY 1), hb AS (SELECT file, count(*) AS n FROM b GROUP BY 1), h AS (SELECT file, ha.n AS was, hb.n AS now FROM ha FULL JOIN hb USING (file) WHERE ha.n IS DISTINCT FROM hb.n),
ca AS (SELECT p, count(*) AS n FROM a GROUP BY 1), cb AS (SELECT p, count(*) AS n FROM b GROUP BY 1),
d AS (SELECT file, k, s, -1 AS c FROM a UNION ALL SELECT file, k, CASE WHEN m = 5 THEN 'X' ELSE s END, 1 FROM b),
t AS (SELECT count(*) FILTER (now IS NOT NULL) AS n FROM h)
SELECT 'healthUpdated' AS type, file AS key, CASE WHEN now IS NOT NULL THEN '{"composite":' || now || '}' END AS payload, NULL::BIGINT AS copies FROM h
UNION ALL SELECT 'notesUpdated', 'n' || k, CASE m WHEN 3 THEN '{"title":"' || p || '"}' END, NULL FROM o WHERE s = 'F' AND m IN (3, 7)
UNION ALL SELECT 'diagnosticsUpdated', file, '{"id":"i' || k || '","code":"' || s || '"}', sum(c)::BIGINT AS n FROM d GROUP BY file, k, s HAVING n <> 0
UNION ALL SELECT CASE WHEN cb.n % 2 = 0 THEN 'capabilityRestored' ELSE 'capabilityDegraded' END, p, CASE WHEN cb.n % 2 = 0 THEN '{"available":true,"reason":"restored"}' ELSE '{"available":false,"reason":"n' || cb.n || '"}' END, NULL
  FROM cb LEFT JOIN ca USING (p) WHERE ca.n IS DISTINCT FROM cb.n AND (cb.n % 2 = 1 OR coalesce(ca.n % 2 = 1, true))
UNION ALL SELECT 'indexProgress', NULL, '{"filesDone":' || i || ',"filesTotal":' || n || '}', NULL FROM (SELECT DISTINCT n, unnest(range(0, n, 50) || [n]) AS i FROM t)
""")
def q_daemon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diagnostics and notes, customers as files with a score, priorities as capabilities, in two versions: events of all kinds."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k, (k % 10).alias("m"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("p"))

    def version(rows: DataFrame) -> dict[str, DataFrame]:
        n, key = F.count(F.lit(1)), F.col("o_orderkey").cast("string")
        scores = rows.groupBy("file").agg(n.alias("composite"))
        return {
            "health": scores,
            "notes": rows.filter("code = 'F'").select(F.concat(F.lit("n"), key).alias("id"), F.col("p").alias("title")),
            "diagnostics": rows.select("file", F.concat(F.lit("i"), key).alias("id"), "code"),
            "capabilities": rows.groupBy(F.col("p").alias("capability")).agg((n % 2 == 0).alias("available"), F.concat(F.lit("n"), n.cast("string")).alias("reason")),
            "files": scores.select(F.col("file").alias("path"), F.col("composite").cast("string").alias("blob_sha")),
        }

    old, new = version(orders.filter("m <> 3")), version(orders.filter("m <> 7"))
    new["diagnostics"] = version(orders.filter("m <> 7").withColumn("code", F.when(F.col("m") == 5, "X").otherwise(F.col("code"))))["diagnostics"]
    return capture.events(old, new)
