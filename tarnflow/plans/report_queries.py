"""Queries for metrics, settings and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.operators import gating, logs, metrics, tensors
from tarnflow.operators.trees import tree_depths
from tarnflow.plans import config
from tarnflow.plans.registry import query
from tarnflow.sources.tables import event_stream, table

HOUR = 3_600_000_000
IS = lambda kind: F.col("event_type") == kind


@query(
    "cumulative_counters",
    """WITH {ev} SELECT stream_id, seq, count(*) OVER w AS frames, round(sum(greatest(value - 20, 0)) OVER w, 6) AS seconds FROM ev
       WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""",
)
def cumulative_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.counters(event_stream(spark, sf_dir), F.col("value") - 20, slices="slice")
    return rows.select("stream_id", "seq", "frames", F.round("seconds", 6).alias("seconds"))


@query(
    "interval_metrics",
    """WITH {ev}, g AS (SELECT stream_id, at_us // 86400000000 AS interval, count(*) AS frames, avg(greatest(value, 0)) AS mean,
         count(CASE WHEN event_type = 'view' THEN value END) AS inferences, round(avg(CASE WHEN event_type = 'view' THEN value END) * 1000, 6) AS inference_avg_ms FROM ev GROUP BY ALL),
       i AS (SELECT stream_id, unnest(range(min(interval), max(interval) + 1)) AS interval FROM g GROUP BY stream_id)
       SELECT stream_id, interval, coalesce(frames, 0) AS frames, coalesce(frames / 86400.0::DOUBLE, 0.0) AS fps, coalesce(round(mean * 1000, 6), 0.0) AS avg_ms,
         coalesce(inferences, 0) AS inferences, inference_avg_ms FROM i LEFT JOIN g USING (stream_id, interval)""",
)
def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interval_metrics(event_stream(spark, sf_dir), 24 * HOUR, F.col("value"), F.when(IS("view"), F.col("value")))


@query(
    "interval_deltas",
    """WITH {ev}, s AS (SELECT stream_id, at_us // 86400000000 AS i, max(at_us) AS published, count(*) AS n FROM ev GROUP BY ALL)
       SELECT stream_id, i AS interval, coalesce(round(n / ((published - lag(published) OVER (PARTITION BY stream_id ORDER BY i)) / 1e6), 9), 0.0) AS fps FROM s""",
)
def interval_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).groupBy("stream_id", F.floor(F.col("at_us") / (24 * HOUR)).alias("interval"))
    rows = rows.agg(F.max("at_us").alias("published"), F.count("*").alias("n"))
    elapsed = (F.col("published") - F.lag("published").over(Window.partitionBy("stream_id").orderBy("interval"))) / 1e6
    return rows.select("stream_id", "interval", F.coalesce(F.round(F.col("n") / elapsed, 9), F.lit(0.0)).alias("fps"))


@query(
    "trailing_average",
    """WITH {ev} SELECT stream_id, seq, round(avg(value) OVER (PARTITION BY stream_id ORDER BY at_us
         RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW), 6) AS average FROM ev""",
)
def trailing_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.trailing_average(event_stream(spark, sf_dir), "average", F.col("value"), 10 * HOUR, width_us=240 * HOUR)
    return rows.select("stream_id", "seq", F.round("average", 6).alias("average"))


@query(
    "stage_average",
    """WITH {ev} SELECT at_us // 86400000000 AS interval, event_type AS stage, round(avg(value) * 1000, 6) AS avg_ms FROM ev
       WHERE event_type IN ('view', 'click') GROUP BY ALL""",
)
def stage_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    rows = rows.groupBy(F.floor(F.col("at_us") / (24 * HOUR)).alias("interval"), F.col("event_type").alias("stage"))
    return rows.agg(F.round(F.avg("value") * 1000, 6).alias("avg_ms"))


@query(
    "connection_status",
    """WITH {ev}, m AS (SELECT stream_id, seq, at_us,
         max(CASE WHEN event_type = 'purchase' THEN at_us END) OVER w AS ok, max(CASE WHEN event_type = 'error' THEN at_us END) OVER w AS bad FROM ev
         WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
       SELECT stream_id, seq, CASE WHEN bad IS NOT NULL AND (ok IS NULL OR bad >= ok) THEN 'failed' WHEN ok IS NULL THEN 'wait'
         WHEN at_us - ok > 360000000000 THEN 'stalled' ELSE 'ok' END AS status FROM m""",
)
def connection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.max(F.when(IS(kind), F.col("at_us"))).over(w)
    rows = event_stream(spark, sf_dir).withColumns({"ok": last("purchase"), "bad": last("error")})
    return rows.select("stream_id", "seq", metrics.connection_status(F.col("ok"), F.col("bad"), F.col("at_us"), 100 * HOUR).alias("status"))


@query(
    "latest_pts",
    """WITH {ev}, l AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) AS r FROM ev WHERE event_type <> 'error')
       SELECT stream_id, CASE WHEN k % 3 > 0 THEN k END AS pts FROM l WHERE r = 1""",
)
def latest_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = F.when(F.col("k") % 3 > 0, F.col("k"))
    return event_stream(spark, sf_dir).groupBy("stream_id").agg(metrics.latest(pts, F.col("seq"), ~IS("error")).alias("pts"))


@query(
    "stream_report",
    """WITH {ev} SELECT stream_id, count(*) AS frames, round(avg(value), 6) AS mean,
         count(*) FILTER (event_type = 'error') AS errors, max(at_us) AS last_us FROM ev GROUP BY stream_id""",
)
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir).groupBy("stream_id").agg(
        F.count("*").alias("frames"), F.round(F.avg("value"), 6).alias("mean"),
        F.count(F.when(IS("error"), 1)).alias("errors"), F.max("at_us").alias("last_us"),
    )


@query("report_scope", "WITH {ev} SELECT stream_id % 3 AS run_id, event_type AS kind, count(*) AS n, round(sum(value), 4) AS seconds FROM ev GROUP BY ALL")
def report_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).groupBy((F.col("stream_id") % 3).alias("run_id"), F.col("event_type").alias("kind"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds"))


@query("frame_latency", "WITH {ev} SELECT stream_id, seq, at_us + service_us AS ended_us, service_us / 1000.0::DOUBLE AS ms FROM ev")
def frame_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.col("at_us") + F.col("service_us")
    return event_stream(spark, sf_dir).select("stream_id", "seq", ended.alias("ended_us"), ((ended - F.col("at_us")) / 1000.0).alias("ms"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, s, gpu: F.struct(F.lit(name).alias("part"), s.alias("seconds"), gpu.alias("gpu_ms"))
    none = F.lit(None).cast("double")
    parts = F.array(
        part("prepare", F.col("value") / 4, none), part("infer", F.col("value") / 2, F.when(F.col("k") % 2 == 0, F.col("value") * 3))
    )
    rows = event_stream(spark, sf_dir).select("event_id", "at_us", F.col("event_type").alias("kind"), (F.col("k") % 6).alias("state"), "value", F.explode(parts).alias("p"))
    return rows.select("event_id", "at_us", "kind", "state", "value", "p.*")


@query(
    "detection_report",
    """WITH {ev}, p AS (SELECT event_type AS kind, 'prepare' AS part, value / 4 AS s, NULL::DOUBLE AS g FROM ev
         UNION ALL SELECT event_type, 'infer', value / 2, CASE WHEN k % 2 = 0 THEN value * 3 END FROM ev)
       SELECT kind, part, round(avg(s) * 1000, 6) AS avg_ms, count(*) AS n, round(avg(g), 6) AS avg_gpu_ms, count(g) AS gpu_n FROM p GROUP BY kind, part""",
)
def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stage_report(_parts(spark, sf_dir), "kind", "part")


@query(
    "detection_windows",
    """WITH {ev}, p AS (SELECT event_type AS kind, at_us, 'prepare' AS part, value / 4 AS s, NULL::DOUBLE AS g FROM ev
         UNION ALL SELECT event_type, at_us, 'infer', value / 2, CASE WHEN k % 2 = 0 THEN value * 3 END FROM ev),
       w AS (SELECT event_type AS kind, max(CASE WHEN k > 90 THEN at_us END) AS since_us, max(at_us) AS now_us FROM ev GROUP BY event_type),
       x AS (SELECT 'window' AS period, p.* FROM p JOIN w USING (kind) WHERE at_us > since_us
             UNION ALL SELECT 'recent', p.* FROM p JOIN w USING (kind) WHERE at_us > now_us - 864000000000)
       SELECT period, kind, part, round(avg(s) * 1000, 6) AS avg_ms, count(*) AS n, round(avg(g), 6) AS avg_gpu_ms, count(g) AS gpu_n FROM x GROUP BY period, kind, part""",
)
def detection_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("kind"))
    since = rows.agg(F.max(F.when(F.col("k") > 90, F.col("at_us"))).alias("since_us"), F.max("at_us").alias("now_us"))
    return metrics.windowed_report(_parts(spark, sf_dir), since, 240 * HOUR, "kind", "part")


@query(
    "detection_states",
    """WITH {ev} SELECT event_type AS kind, count(*) FILTER (k % 6 = 0) AS completed, count(*) FILTER (k % 6 = 1) AS skipped, count(*) FILTER (k % 6 = 2) AS busy,
       count(*) FILTER (k % 6 = 3) AS timeout, count(*) FILTER (k % 6 = 4) AS error, count(*) FILTER (k % 6 = 5) AS partial FROM ev GROUP BY kind""",
)
def detection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["completed", "skipped", "busy", "timeout", "error", "partial"]
    state = F.get(F.array(*[F.lit(n) for n in names]), (F.col("k") % 6).cast("int"))
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("kind"), state.alias("state"))
    return rows.groupBy("kind").pivot("state", names).count().na.fill(0)


@query(
    "bounded_history",
    """WITH {ev}, t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY at_us DESC) AS r FROM ev
         WHERE at_us > (SELECT max(at_us) FROM ev) - 2592000000000)
       SELECT event_type AS kind, event_id FROM t WHERE r <= 50""",
)
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = metrics.bounded_history(event_stream(spark, sf_dir), 50, keys=("event_type",), order="at_us", window_us=720 * HOUR)
    return kept.select(F.col("event_type").alias("kind"), "event_id")


@query(
    "profile_finish",
    """WITH {ev}, p AS (SELECT event_id, 'prepare' AS part, value / 4 AS seconds FROM ev UNION ALL SELECT event_id, 'infer', value / 2 FROM ev
         UNION ALL SELECT event_id, 'other', greatest(0.0, value - value / 4 - value / 2) FROM ev UNION ALL SELECT event_id, 'total', value FROM ev)
       SELECT event_id, part, round(seconds, 6) AS seconds FROM p""",
)
def profile_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    totals = event_stream(spark, sf_dir).select("event_id", F.col("value").alias("total"))
    done = metrics.finish_profile(parts, totals, "event_id")
    return done.select("event_id", "part", F.round("seconds", 6).alias("seconds"))


@query(
    "kind_binding",
    "WITH {ev} SELECT stream_id, seq, coalesce(CASE WHEN k % 3 = 0 THEN 'a' END, CASE WHEN k % 3 = 1 THEN 'b' END, event_type) AS kind FROM ev",
)
def kind_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    kind = metrics.first_kind(F.when(k == 0, "a"), F.when(k == 1, "b"), F.col("event_type"))
    return event_stream(spark, sf_dir).select("stream_id", "seq", kind.alias("kind"))


_BACKENDS = "(VALUES (0, 'tensorrt'), (1, 'torchscript'), (2, 'pkg.mod:Model'), (3, '1bad:'), (4, 'patchcore')) b(i, backend)"


def _backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("tensorrt", "torchscript", "pkg.mod:Model", "1bad:", "patchcore")])
    return event_stream(spark, sf_dir).select("stream_id", "seq", F.get(names, (F.col("k") % 5).cast("int")).alias("backend"))


@query(
    "backend_kind",
    f"""WITH {{ev}} SELECT stream_id, seq, CASE WHEN i = 0 THEN 'TensorRT' WHEN i IN (1, 4) THEN upper(backend) ELSE backend END AS kind
        FROM ev JOIN {_BACKENDS} ON i = k % 5""",
)
def backend_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backends(spark, sf_dir).select("stream_id", "seq", metrics.backend_kind(F.col("backend")).alias("kind"))


@query("validate_backend", f"WITH {{ev}} SELECT stream_id, seq, i <> 3 AS valid FROM ev JOIN {_BACKENDS} ON i = k % 5")
def validate_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backends(spark, sf_dir).select("stream_id", "seq", tensors.valid_backend(F.col("backend")).alias("valid"))


@query(
    "heartbeat_gap",
    """WITH {ev}, g AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY stream_id ORDER BY seq) > 72000000000 THEN 1 ELSE 0 END AS new FROM ev),
       s AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY seq) AS session FROM g)
       SELECT stream_id, session::BIGINT AS session, min(at_us) AS start_us, max(at_us) AS end_us, count(*) AS n FROM s GROUP BY ALL""",
)
def heartbeat_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).groupBy("stream_id", "session").agg(
        F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"), F.count("*").alias("n")
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = event_stream(spark, sf_dir).withColumn("new", metrics.gaps(F.col("at_us"), 20 * HOUR))
    return rows.withColumn("session", F.sum("new").over(w))


@query(
    "idle_shutdown",
    """WITH {ev}, b AS (SELECT *, max(at_us + service_us) OVER (PARTITION BY stream_id ORDER BY seq) AS busy,
         lead(at_us) OVER (PARTITION BY stream_id ORDER BY seq) AS nxt FROM ev)
       SELECT stream_id, busy + 36000000000 AS stopped_us FROM b WHERE nxt IS NULL OR nxt - busy > 36000000000""",
)
def idle_shutdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_stream(spark, sf_dir).select("stream_id", F.col("at_us").alias("start_us"), (F.col("at_us") + F.col("service_us")).alias("end_us"))
    return metrics.idle_periods(spans, 10 * HOUR)


@query(
    "defaults_merge",
    """WITH {ev} SELECT stream_id, seq, CASE WHEN k % 3 = 0 THEN event_type WHEN k % 3 = 1 THEN NULL ELSE 'default' END AS a, 'kept' AS b FROM ev""",
)
def defaults_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = F.create_map(F.lit("a"), F.lit("default"), F.lit("b"), F.lit("kept"))
    k = F.col("k") % 3
    given = F.when(k == 0, F.create_map(F.lit("a"), F.col("event_type"))).when(k == 1, F.create_map(F.lit("a"), F.lit(None).cast("string")))
    rows = event_stream(spark, sf_dir).withColumn("m", config.merged(defaults, given))
    return rows.select("stream_id", "seq", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@query(
    "section_lookup",
    """WITH {ev}, s(event_type, interval) AS (VALUES ('view', 3), ('click', 2))
       SELECT stream_id, seq, coalesce(interval, 1) AS interval FROM ev LEFT JOIN s USING (event_type)""",
)
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame([("view", 3), ("click", 2)], "event_type string, interval int")
    rows = event_stream(spark, sf_dir).join(F.broadcast(sections), "event_type", "left")
    return rows.select("stream_id", "seq", F.coalesce("interval", F.lit(1)).alias("interval"))


@query(
    "live_config",
    """WITH {ev}, c AS (SELECT at_us, max(k) AS setting FROM ev WHERE event_type = 'purchase' GROUP BY at_us)
       SELECT stream_id, seq, setting FROM ev ASOF LEFT JOIN c ON c.at_us <= ev.at_us""",
)
def live_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings hold for all streams, so no key parts the rows."""
    rows = event_stream(spark, sf_dir)
    settings = rows.where(IS("purchase")).select("at_us", F.col("k").alias("setting"))
    return gating.as_of(rows, settings, "at_us", "setting").select("stream_id", "seq", "setting")


@query(
    "step_tree",
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS id, p_partkey // 3 AS parent FROM part),
       r AS (SELECT id, 0 AS depth FROM e WHERE id <= 2 UNION ALL SELECT e.id, r.depth + 1 FROM r JOIN e ON e.parent = r.id WHERE e.id > 2)
       SELECT id, depth FROM r""",
)
def step_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 2, F.floor(key / 3)).alias("parent")).distinct()
    return tree_depths(nodes)


@query("name_validation", "SELECT DISTINCT name, regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') AS valid FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source || ' ' || lang ELSE source END AS name FROM documents)")
def name_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "source", "lang")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(name.alias("name")).distinct().withColumn("valid", logs.valid_name(F.col("name")))


@query(
    "log_policy",
    """WITH {ev}, l(name, level, disabled) AS (VALUES ('app', 30, false), ('app.view', 10, false), ('app.click', 0, false), ('app.error', 40, true)),
       r AS (SELECT event_id AS id, 'app.' || event_type || '.m' || (k % 2)::VARCHAR AS name, (k % 5 + 1) * 10 AS level FROM ev),
       x AS (SELECT id, r.name, r.level, arg_max(l.level, length(l.name)) FILTER (l.level > 0) AS least, bool_or(l.disabled AND l.name = r.name) AS off
             FROM r LEFT JOIN l ON r.name = l.name OR starts_with(r.name, l.name || '.') GROUP BY ALL)
       SELECT id, name, level, level > 10 AND NOT coalesce(off, false) AND level >= coalesce(least, 20) AS enabled FROM x""",
)
def log_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.createDataFrame(
        [("app", 30, False), ("app.view", 10, False), ("app.click", 0, False), ("app.error", 40, True)], "name string, level int, disabled boolean"
    )
    name = F.concat(F.lit("app."), "event_type", F.lit(".m"), (F.col("k") % 2).cast("string"))
    records = event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), name.alias("name"), ((F.col("k") % 5 + 1) * 10).alias("level"))
    return logs.log_policy(records, levels, root=20, disable=10)


@query(
    "safe_payload",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k": ' || json_extract(props, '$.k') || '}'
         WHEN 1 THEN '[{"a": [{"b": "{''k'': ' || json_extract(props, '$.k') || '}"}]}]' ELSE '"not JSON ' || event_type || '"' END AS payload FROM events""",
)
def safe_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.concat(F.lit('[{"a": [{"b": '), "props", F.lit("}]}]"))
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, deep).otherwise(F.concat(F.lit("not JSON "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", logs.safe_payload(text).alias("payload"))


#: Lines of a text and their parts of 40 bytes: a part takes all characters that end within 40 bytes of its start.
_LINES = """l AS (SELECT *, string_split(CASE WHEN ends_with(body, chr(10)) THEN body[:-2] ELSE body END, chr(10)) AS a FROM t WHERE length(body) > 0),
       x AS (SELECT KEYS, generate_subscripts(a, 1) - 1 AS line, unnest(a) AS whole FROM l),
       c AS (SELECT KEYS, line, whole, 0 AS part, 1 AS first, (SELECT count(*) FROM range(least(length(whole), 40)) n(i) WHERE strlen(whole[1:i + 1]) <= 40) AS n FROM x
             UNION ALL
             SELECT KEYS, line, whole, part + 1, first + n, (SELECT count(*) FROM range(40) m(i) WHERE first + n + i <= length(whole) AND strlen(whole[first + n:first + n + i]) <= 40)
             FROM c WHERE first + n <= length(whole))
       SELECT KEYS, line, part, whole[first:first + n - 1] AS text FROM c"""


@query("log_lines", "WITH RECURSIVE t AS (SELECT conv_id, turn, text AS body FROM conversations), " + _LINES.replace("KEYS", "conv_id, turn"))
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.lines(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn", chunk=40)


@query(
    "log_writes",
    "WITH RECURSIVE t AS (SELECT conv_id, string_agg(coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN chr(10) ELSE '' END, '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id), "
    + _LINES.replace("KEYS", "conv_id"),
)
def log_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a thread's writes, of which every third ends its line."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, "\n").otherwise(""))
    writes = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return logs.written_lines(writes, "text", thread="conv_id", order="turn", chunk=40)
