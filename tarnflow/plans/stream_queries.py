"""Queries over the ordered event stream: sources, sampling, gates, timestamps, recovery, state machines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.operators import batching, codec, gating, inference, publish, recovery, replay, sampling, tensors, timestamps
from tarnflow.plans.pipeline import Apply, Change, EveryNFrames, Pipeline
from tarnflow.plans.registry import query
from tarnflow.sources import packets
from tarnflow.sources.tables import event_stream

HOUR = 3_600_000_000
IS = lambda kind: F.col("event_type") == kind


@query(
    "source_packets",
    """WITH {ev}, c AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS connection FROM ev),
       m AS (SELECT stream_id, connection, k AS width FROM c WHERE event_type = 'purchase')
       SELECT stream_id, seq, c.k AS size, connection, m.width FROM c JOIN m USING (stream_id, connection) WHERE c.k % 7 > 0 AND m.width % 3 > 0""",
)
def source_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("size", F.when(F.col("k") % 7 > 0, F.col("k")))
    found = packets.connect(rows, IS("purchase"), F.col("k"), F.col("k") % 3 > 0, slices="slice")
    return found.select("stream_id", "seq", "size", "connection", F.col("metadata").alias("width"))


@query(
    "stream_metadata_valid",
    """WITH {ev} SELECT stream_id, seq, coalesce(length(trim(CASE WHEN k % 7 = 0 THEN ' ' ELSE event_type END)) > 0
       AND k > 0 AND value > 1 AND seq >= 0 AND (k % 5 = 0 OR k - 2 > 0), false) AS valid FROM ev""",
)
def stream_metadata_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir)
    codec = F.when(F.col("k") % 7 == 0, " ").otherwise(F.col("event_type"))
    rate = F.when(F.col("k") % 5 != 0, F.col("k") - 2)
    ok = packets.valid_stream(codec, F.col("k"), F.ceil(F.col("value") - 1), F.col("seq"), rate, F.lit(None).cast("long"))
    return rows.select("stream_id", "seq", ok.alias("valid"))


@query(
    "connection_generations",
    """WITH {ev} SELECT stream_id, seq, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
       OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS generation FROM ev""",
)
def connection_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.generations(event_stream(spark, sf_dir), "generation", IS("purchase"), slices="slice").select("stream_id", "seq", "generation")


@query(
    "output_generations",
    """WITH {ev}, c AS (SELECT *, CASE WHEN seq > 0 AND (seq // 20, event_type, k % 2, nullif(k % 3, 0)) IS DISTINCT FROM
         lag((seq // 20, event_type, k % 2, nullif(k % 3, 0))) OVER (PARTITION BY stream_id ORDER BY seq) THEN 1 ELSE 0 END AS c FROM ev)
       SELECT stream_id, seq, sum(c) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS generation FROM c""",
)
def output_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"connection_id": F.floor(F.col("seq") / 20), "stream_index": F.lit(0), "codec": F.col("event_type"), "width": F.col("k") % 2}
    known |= {"height": F.lit(1), "extradata": F.lit(None).cast("binary"), "stream_base": F.nullif(F.col("k") % 3, F.lit(0).cast("long"))}
    rows = event_stream(spark, sf_dir).withColumns(known)
    return packets.key_generations(rows, "generation", *publish.KEY, slices="slice").select("stream_id", "seq", "generation")


@query(
    "dts_fill",
    "WITH {ev} SELECT stream_id, seq, coalesce(CASE WHEN k % 3 > 0 THEN k END, k + 100) AS dts FROM ev",
)
def dts_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    dts = timestamps.fill_dts(F.when(F.col("k") % 3 > 0, F.col("k")), F.col("k") + 100)
    return event_stream(spark, sf_dir).select("stream_id", "seq", dts.alias("dts"))


@query(
    "dts_fill_chain",
    """WITH RECURSIVE {ev}, p AS (SELECT stream_id, seq, CASE WHEN k % 3 > 0 THEN k * 10 + seq * 40 END AS d,
         CASE WHEN k % 2 = 0 THEN 1000 ELSE 90000 END AS den FROM ev),
       r AS (
         SELECT stream_id, seq, coalesce(d, 0) AS dts, true AS sent, coalesce(d, 0) AS last, den AS last_den FROM p WHERE seq = 0
         UNION ALL
         SELECT p.stream_id, p.seq, x.v, x.v * r.last_den > r.last * p.den,
                CASE WHEN x.v * r.last_den > r.last * p.den THEN x.v ELSE r.last END,
                CASE WHEN x.v * r.last_den > r.last * p.den THEN p.den ELSE r.last_den END
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1,
              LATERAL (SELECT coalesce(p.d, (r.last * p.den) // r.last_den + 40) AS v) x)
       SELECT stream_id, seq, dts FROM r WHERE sent""",
)
def dts_fill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select(
        "stream_id", "seq", F.when(F.col("k") % 3 > 0, F.col("k") * 10 + F.col("seq") * 40).alias("dts"), F.lit(None).cast("long").alias("pts"),
        F.lit(1).alias("num"), F.when(F.col("k") % 2 == 0, 1000).otherwise(90000).alias("den"), F.lit(40).alias("duration"),
    )
    return replay.replay(rows, replay.chained_dts, "seq long, dts long", start=lambda: None)


@query(
    "dts_gate",
    """WITH {ev}, t AS (SELECT *, max(k) OVER (PARTITION BY stream_id ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev)
       SELECT stream_id, seq, k AS dts FROM t WHERE top IS NULL OR k > top""",
)
def dts_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.monotonic_gate(event_stream(spark, sf_dir), F.col("k"), slices="slice").select("stream_id", "seq", F.col("k").alias("dts"))


@query(
    "dts_gate_bases",
    """WITH {ev}, b AS (SELECT *, (k * CASE WHEN seq % 2 = 0 THEN 90 ELSE 1 END) AS t90 FROM ev),
       t AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN t90 END) OVER (PARTITION BY stream_id ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b)
       SELECT stream_id, seq FROM t WHERE top IS NULL OR t90 > top""",
)
def dts_gate_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    den = F.when(F.col("seq") % 2 == 0, 1000).otherwise(90_000)
    at = gating.seconds(F.col("k"), F.lit(1), den)
    return gating.monotonic_gate(event_stream(spark, sf_dir), at, sent=~IS("error"), slices="slice").select("stream_id", "seq")


@query(
    "dts_gate_resets",
    """WITH {ev}, b AS (SELECT *, (k - 50) * CASE WHEN seq % 2 = 0 THEN 1001 ELSE 30 END AS t,
         sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS run FROM ev),
       m AS (SELECT *, max(CASE WHEN event_type NOT IN ('signup', 'error') THEN t END) OVER (PARTITION BY stream_id, run ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b)
       SELECT stream_id, seq FROM m WHERE event_type <> 'signup' AND (top IS NULL OR t > top)""",
)
def dts_gate_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    den = F.when(F.col("seq") % 2 == 0, 30).otherwise(1001)
    at = gating.seconds(F.col("k") - 50, F.lit(1), den)
    return gating.monotonic_gate(event_stream(spark, sf_dir), at, sent=~IS("error"), resets=IS("signup"), slices="slice").select("stream_id", "seq")


@query(
    "packet_guard",
    "WITH {ev} SELECT stream_id, seq, NOT (event_type = 'error' OR k % 11 = 0 OR coalesce(CASE WHEN k % 2 = 0 THEN k % 13 = 0 END, false)) AND k % 7 > 0 AS valid FROM ev",
)
def packet_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    disposable = F.when(F.col("k") % 2 == 0, F.col("k") % 13 == 0)
    valid = publish.valid_packet(IS("error"), F.col("k") % 11 == 0, disposable, F.lit(1), F.nullif(F.col("k") % 7, F.lit(0).cast("long")))
    return event_stream(spark, sf_dir).select("stream_id", "seq", valid.alias("valid"))


@query(
    "publish_packets",
    """WITH RECURSIVE {ev}, p AS (SELECT stream_id, seq, at_us, seq // 7 AS key, event_type <> 'signup' AS valid, k % 4 <> 1 AS opens, event_type <> 'error' AS writes,
         CASE WHEN k % 3 > 0 THEN k * 10 + seq * 40 END AS dts, CASE WHEN k % 6 = 0 THEN seq * 50 END AS pts, CASE WHEN k % 5 = 0 THEN 1 ELSE 40 END AS dur,
         CASE WHEN k % 2 = 0 THEN 90 ELSE 1 END AS u FROM ev),
       r AS (
         SELECT DISTINCT stream_id, -1::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::BIGINT AS dts, false AS open, NULL::BIGINT AS key, NULL::BIGINT AS last, NULL::BIGINT AS retry FROM p
         UNION ALL
         SELECT p.stream_id, p.seq, b.outcome, CASE WHEN b.outcome = 'sent' THEN a.v END, b.outcome IN ('sent', 'late'), CASE WHEN b.outcome <> 'bad' THEN p.key END,
                CASE WHEN b.outcome = 'sent' THEN a.v * p.u WHEN b.outcome <> 'bad' THEN s.l END,
                CASE WHEN b.outcome IN ('failed', 'bad') THEN p.at_us + 108000000000 ELSE r.retry END
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1,
              LATERAL (SELECT r.open AND r.key IS NOT DISTINCT FROM p.key AS o, CASE WHEN r.key IS NOT DISTINCT FROM p.key THEN r.last END AS l) s,
              LATERAL (SELECT CASE WHEN NOT s.o AND p.at_us < r.retry THEN 'skipped' WHEN NOT s.o AND NOT p.opens THEN 'failed' WHEN NOT p.valid THEN 'bad' END AS early,
                              coalesce(p.dts, p.pts, s.l // p.u + p.dur, 0) AS v) a,
              LATERAL (SELECT coalesce(a.early, CASE WHEN a.v * p.u <= s.l THEN 'late' WHEN NOT p.writes THEN 'failed' ELSE 'sent' END) AS outcome) b)
       SELECT stream_id, seq, outcome, dts FROM r WHERE seq >= 0""",
)
def publish_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seq = F.col("k"), F.col("seq")
    rows = event_stream(spark, sf_dir).select(
        "stream_id", "seq", "at_us", F.floor(seq / 7).alias("key"), (~IS("signup")).alias("valid"), (k % 4 != 1).alias("opens"), (~IS("error")).alias("writes"),
        F.when(k % 3 > 0, k * 10 + seq * 40).alias("dts"), F.when(k % 6 == 0, seq * 50).alias("pts"), F.when(k % 5 > 0, 40).alias("duration"),
        F.lit(1).alias("num"), F.when(k % 2 == 0, 1000).otherwise(90_000).alias("den"),
    )
    return publish.publish_packets(rows, 30 * HOUR)


@query(
    "time_base",
    "WITH {ev} SELECT stream_id, seq, coalesce(CASE WHEN k % 3 = 0 THEN 1000 END, CASE WHEN k % 3 = 1 THEN 90000 END, 30) AS den FROM ev",
)
def time_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    den = timestamps.time_base(F.when(k == 0, 1000), F.when(k == 1, 90_000), F.lit(30))
    return event_stream(spark, sf_dir).select("stream_id", "seq", den.alias("den"))


@query(
    "codec_lookup",
    """WITH {ev}, c(event_type, codec) AS (VALUES ('view', 'h264'), ('click', 'hevc'), ('signup', 'hevc'))
       SELECT stream_id, seq, codec FROM ev JOIN c USING (event_type)""",
)
def codec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map(*[F.lit(x) for x in ("view", "h264", "click", "hevc", "signup", "h265", "purchase", "vp9")])
    known = F.create_map(*[F.lit(x) for pair in codec.CODECS.items() for x in pair])
    rows = event_stream(spark, sf_dir).withColumn("codec", F.try_element_at(known, F.try_element_at(given, F.col("event_type"))))
    return rows.where("codec is not null").select("stream_id", "seq", "codec")


class Delayed:
    """A codec that gives each row's values at the next row."""

    def __init__(self, make: Callable[[dict], list]) -> None:
        self.make, self.held = make, []

    def step(self, row: dict) -> list:
        out, self.held = self.held, self.make(row)
        return out

    def flush(self) -> list:
        return self.step({"k": 0, "seq": 0, "pts": 0})


def frames_of() -> Delayed:
    return Delayed(lambda row: [(f"f{row['seq']}.{i}", row["pts"]) for i in range(row["k"] % 3)])


def packets_of() -> Delayed:
    return Delayed(lambda row: [f"p{row['seq']}.{i}" for i in range(row["k"] % 3)])


@query(
    "decode_frames",
    """WITH RECURSIVE {ev}, p AS (SELECT stream_id, seq, k, seq // 9 AS key, k % 2 = 0 AS keyframe, event_type IN ('error', 'purchase') AS broken, k * 10 AS pts,
         CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 40 ELSE 25 END AS den FROM ev),
       r AS (
         SELECT DISTINCT stream_id, -1::BIGINT AS seq, NULL::BIGINT AS key, -1::BIGINT AS session, false AS waits, false AS known, NULL::BIGINT AS base,
                NULL::BIGINT AS hseq, 0::BIGINT AS hn, NULL::BIGINT AS hpts, NULL::BIGINT AS o_seq, 0::BIGINT AS o_n, NULL::BIGINT AS o_pts FROM p
         UNION ALL
         SELECT p.stream_id, p.seq, p.key, s.session, CASE WHEN s.skip THEN true ELSE p.broken END, NOT (s.skip OR p.broken), CASE WHEN NOT (s.skip OR p.broken) THEN b.base END,
                CASE WHEN s.skip OR p.broken THEN NULL ELSE p.seq END, CASE WHEN s.skip OR p.broken THEN 0 ELSE p.k % 3 END,
                CASE WHEN s.skip OR p.broken THEN NULL WHEN p.den IS NULL OR b.base IS NULL THEN p.pts ELSE round_even(p.pts * b.base::DOUBLE / p.den, 0)::BIGINT END,
                r.hseq, CASE WHEN s.skip OR p.broken OR NOT s.known THEN 0 ELSE r.hn END, r.hpts
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1,
              LATERAL (SELECT r.key IS DISTINCT FROM p.key AS changed) c,
              LATERAL (SELECT r.session + CASE WHEN c.changed THEN 1 ELSE 0 END AS session, r.known AND NOT c.changed AS known,
                              CASE WHEN c.changed THEN r.key IS NOT NULL ELSE r.waits END AND NOT p.keyframe AS skip) s,
              LATERAL (SELECT CASE WHEN s.known THEN r.base ELSE p.den END AS base) b),
       e AS (SELECT stream_id, seq, session, o_seq AS hseq, o_n AS n, o_pts AS pts, base AS den FROM r WHERE o_n > 0
             UNION ALL SELECT stream_id, seq, session, hseq, hn, hpts, base FROM r WHERE hn > 0 AND seq = (SELECT max(seq) FROM p WHERE p.stream_id = r.stream_id))
       SELECT stream_id, seq, session, 'f' || hseq || '.' || unnest(range(n)) AS frame, pts, CASE WHEN den IS NOT NULL THEN 1 END::BIGINT AS num, den FROM e""",
)
def decode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    given = F.create_map(*[F.lit(x) for x in ("view", "h264", "click", "HEVC", "signup", "h265", "purchase", "vp9", "error", "h264")])
    rows = event_stream(spark, sf_dir).select(
        "stream_id", "seq", "k", F.floor(F.col("seq") / 9).alias("key"), F.try_element_at(given, F.col("event_type")).alias("codec"), (k % 2 == 0).alias("keyframe"),
        IS("error").alias("failed"), (k * 10).alias("pts"), F.when(k % 7 > 0, 1).alias("num"), F.when(k % 7 == 0, None).when(k % 5 == 0, 40).otherwise(25).alias("den"),
    )
    return codec.decode(rows, frames_of)


@query(
    "keyframe_gate",
    """WITH {ev}, w AS (SELECT *,
         greatest(max(CASE WHEN event_type = 'purchase' THEN seq END) OVER u,
                  max(CASE WHEN event_type = 'error' THEN seq + 1 END) OVER b) AS reset,
         max(CASE WHEN event_type = 'signup' THEN seq END) OVER u AS key FROM ev
         WINDOW u AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                b AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT stream_id, seq FROM w WHERE reset IS NULL OR key >= reset""",
)
def keyframe_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir)
    return gating.keyframe_gate(rows, IS("purchase"), IS("error"), IS("signup"), slices="slice").select("stream_id", "seq")


@query(
    "pts_rescale",
    """WITH {ev}, b AS (SELECT *, first_value(CASE WHEN k % 4 > 0 THEN k % 4 * 1000 END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq) AS base FROM ev)
       SELECT stream_id, seq, CASE WHEN k % 4 > 0 THEN CAST(round_even((k * base)::DECIMAL(20,0) / (k % 4 * 1000), 0) AS BIGINT) END AS pts FROM b""",
)
def pts_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    den = F.col("k") % 4 * 1000
    rows = timestamps.session_base(event_stream(spark, sf_dir), "base", F.lit(1), den, slices="slice")
    pts = timestamps.rescale(F.col("k"), F.lit(1), den, F.col("base.num"), F.col("base.den"))
    return rows.select("stream_id", "seq", pts.alias("pts"))


@query(
    "bounded_queue",
    """WITH RECURSIVE {ev},
       r AS (
         SELECT DISTINCT stream_id, 0::BIGINT AS nxt, NULL::BIGINT AS free, []::BIGINT[] AS q, 0::BIGINT AS dropped, NULL::BIGINT AS seq, NULL::BIGINT AS taken_us FROM ev
         UNION ALL
         SELECT r.stream_id, CASE WHEN take THEN r.nxt ELSE r.nxt + 1 END, CASE WHEN take THEN begin_us + h.service_us ELSE r.free END,
                CASE WHEN take THEN r.q[2:] WHEN len(r.q) = 3 THEN list_append(r.q[2:], r.nxt) ELSE list_append(r.q, r.nxt) END,
                CASE WHEN NOT take AND len(r.q) = 3 THEN r.dropped + 1 ELSE r.dropped END,
                CASE WHEN take THEN h.seq END, CASE WHEN take THEN begin_us END
         FROM r LEFT JOIN ev h ON h.stream_id = r.stream_id AND h.seq = r.q[1] LEFT JOIN ev a ON a.stream_id = r.stream_id AND a.seq = r.nxt,
              LATERAL (SELECT greatest(coalesce(r.free, h.at_us), h.at_us) AS begin_us) b,
              LATERAL (SELECT h.seq IS NOT NULL AND (a.seq IS NULL OR b.begin_us <= a.at_us) AS take) t
         WHERE h.seq IS NOT NULL OR a.seq IS NOT NULL)
       SELECT stream_id, seq, taken_us, dropped FROM r WHERE seq IS NOT NULL""",
)
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = replay.DropOldest(3)
    schema = "seq long, taken_us long, dropped long"
    return replay.replay(event_stream(spark, sf_dir), queue.step, schema, start=queue.start, finish=queue.finish)


@query(
    "bounded_queue_events",
    """WITH RECURSIVE {ev},
       r AS (
         SELECT DISTINCT stream_id, 0::BIGINT AS nxt, NULL::BIGINT AS free, []::BIGINT[] AS q, 0::BIGINT AS dropped, false AS ended, NULL::BIGINT AS seq, NULL::BIGINT AS taken_us FROM ev
         UNION ALL
         SELECT r.stream_id, CASE WHEN take THEN r.nxt ELSE r.nxt + 1 END, CASE WHEN take THEN begin_us + h.service_us ELSE r.free END,
                CASE WHEN take THEN r.q[2:] WHEN fails OR gone THEN [] WHEN len(r.q) = 3 THEN list_append(r.q[2:], r.nxt) ELSE list_append(r.q, r.nxt) END,
                CASE WHEN take OR fails THEN r.dropped WHEN gone THEN r.dropped + len(r.q) WHEN len(r.q) = 3 THEN r.dropped + 1 ELSE r.dropped END,
                NOT take AND coalesce(fails, false),
                CASE WHEN take THEN h.seq WHEN fails THEN a.seq END, CASE WHEN take THEN begin_us WHEN fails THEN greatest(a.at_us, coalesce(r.free, a.at_us)) END
         FROM r LEFT JOIN ev h ON h.stream_id = r.stream_id AND h.seq = r.q[1] LEFT JOIN ev a ON a.stream_id = r.stream_id AND a.seq = r.nxt,
              LATERAL (SELECT greatest(coalesce(r.free, h.at_us), h.at_us) AS begin_us, a.event_type = 'purchase' AND a.k % 9 = 0 AS fails, a.event_type = 'error' AS gone) b,
              LATERAL (SELECT h.seq IS NOT NULL AND (a.seq IS NULL OR b.begin_us <= a.at_us) AS take) t
         WHERE NOT r.ended AND (h.seq IS NOT NULL OR a.seq IS NOT NULL))
       SELECT stream_id, seq, taken_us, dropped FROM r WHERE seq IS NOT NULL""",
)
def bounded_queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = replay.DropOldest(3)
    rows = event_stream(spark, sf_dir).withColumns({"discard": IS("error"), "failed": IS("purchase") & (F.col("k") % 9 == 0)})
    return replay.replay(rows, queue.step, "seq long, taken_us long, dropped long", start=queue.start, finish=queue.finish)


_ENCODE = """WITH RECURSIVE {ev}, p AS (SELECT stream_id, seq, at_us, k, seq // 8 AS key, event_type = 'error' AS failed FROM ev WHERE USABLE),
       o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS n FROM p),
       r AS (
         SELECT DISTINCT stream_id, -1::BIGINT AS n, -1::BIGINT AS seq, false AS open, NULL::BIGINT AS key, -1::BIGINT AS generation, 0::BIGINT AS made, 0::BIGINT AS nxt, NULL::BIGINT AS retry, NULL::BIGINT AS hseq, 0::BIGINT AS hn, []::BIGINT[] AS times,
                NULL::BIGINT AS f_at, NULL::BIGINT AS f_seq, 0::BIGINT AS f_n, NULL::BIGINT AS f_gen, NULL::BIGINT AS f_made, NULL::BIGINT AS f_nxt, []::BIGINT[] AS f_times,
                NULL::BIGINT AS o_seq, 0::BIGINT AS o_n, NULL::BIGINT AS o_made, NULL::BIGINT AS o_nxt, []::BIGINT[] AS o_times FROM o
         UNION ALL
         SELECT o.stream_id, o.n, o.seq, m.act = 'run', CASE WHEN m.act = 'wait' THEN r.key ELSE o.key END, m.gen,
                CASE WHEN m.act = 'run' THEN m.made + e.got ELSE m.made END, m.nxt + e.got, CASE WHEN m.act = 'fail' THEN o.at_us + 108000000000 ELSE r.retry END,
                CASE WHEN m.act = 'run' THEN o.seq END, CASE WHEN m.act = 'run' THEN o.k % 3 ELSE 0 END,
                CASE WHEN m.act = 'run' THEN list_append(m.times, o.k)[e.got + 1:] ELSE [] END,
                r.seq, r.hseq, c.flushed, r.generation, r.made, r.nxt, r.times,
                m.hseq, e.got, m.made, m.nxt, list_append(m.times, o.k)
         FROM r JOIN o ON o.stream_id = r.stream_id AND o.n = r.n + 1,
              LATERAL (SELECT r.open AND r.key <> o.key AS changed) x,
              LATERAL (SELECT CASE WHEN x.changed THEN FLUSHED ELSE 0 END AS flushed, r.open AND NOT x.changed AS open) c,
              LATERAL (SELECT CASE WHEN NOT c.open AND o.at_us < r.retry THEN 'wait' WHEN o.failed THEN 'fail' ELSE 'run' END AS act) w,
              LATERAL (SELECT w.act, CASE WHEN c.open OR w.act = 'wait' THEN r.generation ELSE r.generation + 1 END AS gen, CASE WHEN c.open THEN r.made ELSE 0 END AS made, r.nxt + c.flushed AS nxt,
                              CASE WHEN c.open THEN r.hn ELSE 0 END AS hn, r.hseq, CASE WHEN c.open THEN r.times ELSE [] END AS times) m,
              LATERAL (SELECT CASE WHEN w.act = 'run' THEN GOT ELSE 0 END AS got) e),
       e AS (SELECT stream_id, f_at AS seq, f_gen AS generation, f_seq AS hseq, f_n AS n, f_made AS made, f_nxt AS nxt, f_times AS times FROM r WHERE f_n > 0
             UNION ALL SELECT stream_id, seq, generation, o_seq, o_n, o_made, o_nxt, o_times FROM r WHERE o_n > 0
             UNION ALL SELECT stream_id, seq, generation, hseq, LAST, made, nxt, times FROM r WHERE open AND n = (SELECT max(n) FROM o WHERE o.stream_id = r.stream_id)),
       u AS (SELECT *, unnest(range(n)) AS i FROM e)
       SELECT stream_id, seq, generation, 'p' || hseq || '.' || i AS packet, PTS AS pts, 1::BIGINT AS num, DEN AS den, DUR AS duration, (made + i) % 4 = 0 AS keyframe FROM u"""


def _encode_sql(**parts: str) -> str:
    sql = _ENCODE
    for name, text in parts.items():
        sql = sql.replace(name, text)
    return sql


def _frames(spark: SparkSession, sf_dir: str, usable: Column, den: Column) -> DataFrame:
    return event_stream(spark, sf_dir).select(
        "stream_id", "seq", "at_us", "k", F.floor(F.col("seq") / 8).alias("key"), usable.alias("usable"), IS("error").alias("failed"),
        F.col("k").alias("pts"), F.lit(1).alias("num"), den.alias("den"), F.lit(3).alias("duration"),
    )


@query(
    "encode_frames",
    _encode_sql(USABLE="event_type <> 'signup'", FLUSHED="r.hn", GOT="m.hn", LAST="hn", PTS="nxt + i", DEN="4::BIGINT", DUR="1::BIGINT"),
)
def encode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(_frames(spark, sf_dir, ~IS("signup"), F.lit(90)), packets_of, fps=4, wait_us=30 * HOUR)


@query(
    "encode_preserved",
    _encode_sql(
        USABLE="k % 5 > 0", FLUSHED="least(r.hn, len(r.times))", GOT="least(m.hn, len(m.times) + 1)", LAST="least(hn, len(times))", PTS="times[i + 1]", DEN="90::BIGINT", DUR="3::BIGINT"
    ),
)
def encode_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir, F.lit(True), F.when(F.col("k") % 5 > 0, 90).otherwise(0))
    return codec.encode(frames, packets_of, fps=4, wait_us=30 * HOUR, preserve=True)


@query(
    "generated_timestamps",
    """WITH {ev}, o AS (SELECT stream_id, seq, unnest(range(k % 3)) AS part FROM ev)
       SELECT stream_id, seq, part, row_number() OVER (PARTITION BY stream_id ORDER BY seq, part) - 1 AS pts FROM o""",
)
def generated_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).where(F.col("k") % 3 > 0)
    rows = rows.select("stream_id", "seq", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 3 - 1)).alias("part"))
    return timestamps.generated(rows, "pts", "seq", "part", slices="slice").drop("slice")


@query(
    "preserved_timestamps",
    """WITH {ev}, x AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS lost FROM ev),
       f AS (SELECT stream_id, lost, seq, k AS pts, row_number() OVER (PARTITION BY stream_id, lost ORDER BY seq) AS n FROM x WHERE k % 5 > 0 AND event_type <> 'error'),
       p AS (SELECT stream_id, lost, event_id, row_number() OVER (PARTITION BY stream_id, lost ORDER BY seq) AS n FROM x WHERE value > 50)
       SELECT f.stream_id, f.seq, f.pts, p.event_id FROM f JOIN p USING (stream_id, lost, n)""",
)
def preserved_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timestamps.failures(event_stream(spark, sf_dir), "lost", IS("error"), slices="slice")
    pts = F.when(~IS("error"), F.col("k"))
    valid = timestamps.valid_time(pts, F.lit(1), F.col("k") % 5, F.lit(None).cast("long"))
    frames = rows.select("stream_id", "lost", "seq", F.col("k").alias("pts"), valid.alias("valid"))
    out = rows.where("value > 50").select("stream_id", "lost", "seq", "event_id")
    return timestamps.preserve(frames, out, F.col("valid"), keys=("stream_id", "lost")).select("stream_id", "seq", "pts", "event_id")


_BACKOFF = """WITH RECURSIVE {ev}, p AS (SELECT *, event_type = 'error' AS failed FROM ev),
  r AS (
    SELECT stream_id, seq, CASE WHEN failed THEN 'failed' ELSE 'sent' END AS outcome,
           CASE WHEN failed THEN at_us + 108000000000 END AS retry, NOT failed AS open FROM p WHERE seq = 0
    UNION ALL
    SELECT p.stream_id, p.seq,
           CASE WHEN NOT r.open AND p.at_us < r.retry THEN 'skipped' WHEN p.failed THEN 'failed' ELSE 'sent' END,
           CASE WHEN NOT r.open AND p.at_us < r.retry THEN r.retry WHEN p.failed THEN p.at_us + 108000000000 ELSE r.retry END,
           CASE WHEN NOT r.open AND p.at_us < r.retry THEN false ELSE NOT p.failed END
    FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1)
  SELECT stream_id, seq, outcome FROM r"""


@query("backoff_gate", _BACKOFF)
def backoff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("failed", IS("error"))
    return replay.replay(rows, replay.back_off(30 * HOUR), "seq long, outcome string", start=lambda: (None, False))


@query("publish_gaps", _BACKOFF.replace("SELECT stream_id, seq, outcome FROM r", "SELECT stream_id, seq FROM r WHERE outcome = 'sent'"))
def publish_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_gate(spark, sf_dir).where("outcome = 'sent'").select("stream_id", "seq")


@query(
    "encoded_bytes",
    """WITH {ev} SELECT stream_id, seq, CASE WHEN k % 3 = 0 THEN event_type || '1' WHEN k % 3 = 1 THEN event_type || '2' ELSE event_type || '3' END AS bytes FROM ev""",
)
def encoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k") % 3
    one = F.create_map(F.lit("data"), F.concat(kind, F.lit("2")), F.lit("bitstream"), F.concat(kind, F.lit("1")))
    two = F.create_map(F.lit("x"), F.concat(kind, F.lit("9")), F.lit("data"), F.concat(kind, F.lit("2")))
    other = F.create_map(F.lit("x"), F.concat(kind, F.lit("3")))
    found = F.when(k == 0, one).when(k == 1, two).otherwise(other)
    return event_stream(spark, sf_dir).select("stream_id", "seq", tensors.first_bytes(found).alias("bytes"))


@query(
    "encoded_bytes_nested",
    """WITH {ev} SELECT stream_id, seq, CASE k % 5 WHEN 0 THEN hex(k::UTINYINT::INT) WHEN 1 THEN '0102' WHEN 2 THEN '07' WHEN 3 THEN NULL ELSE '' END AS bytes
       FROM ev""".replace("hex(k::UTINYINT::INT)", "printf('%02X%02X', k::INT, k::INT)"),
)
def encoded_bytes_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    own = F.concat(F.lit('{"x": [9], "packet": {"y": "no", "payload": ['), k, F.lit(","), k, F.lit("]}}"))
    answer = F.when(k % 5 == 0, own).when(k % 5 == 1, '[{"n": "a"}, {"data": null, "z": [1, 2]}]').when(k % 5 == 2, '{"bitstream": "no", "other": [[], 5], "payload": [7]}')
    answer = answer.when(k % 5 == 3, '{"data": "no", "n": 1.5}').otherwise("[]")
    rows = tensors.encoded_bytes(event_stream(spark, sf_dir), "bytes", answer)
    return rows.select("stream_id", "seq", F.hex("bytes").alias("bytes"))


@query(
    "nal_headers",
    """WITH {ev} SELECT stream_id, seq, CASE WHEN k % 2 = 0 THEN '0000000167aa' || '0000000168' ELSE '' END AS headers FROM ev""",
)
def nal_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = F.when(F.col("k") % 2 == 0, "0000000167AA00000168000001650102").otherwise("0000016501000000000141")
    return event_stream(spark, sf_dir).select("stream_id", "seq", tensors.header_units(F.lit("h264"), F.unhex(stream)).alias("headers"))


@query("drop_frames", "WITH {ev} SELECT stream_id, seq, value FROM ev WHERE seq % 3 = 0")
def drop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.drop_frames(event_stream(spark, sf_dir), 3, slices="slice").select("stream_id", "seq", "value")


@query("every_n_frames", "WITH {ev} SELECT stream_id, seq, CASE WHEN seq % 3 = 0 THEN value * 2 ELSE value END AS value FROM ev")
def every_n_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.every_n(event_stream(spark, sf_dir), {"value": F.col("value") * 2}, 3, slices="slice").select("stream_id", "seq", "value")


@query("every_n_live", "WITH {ev} SELECT stream_id, seq, CASE WHEN seq % (CASE WHEN seq < 2 THEN 3 ELSE 2 END) = 0 THEN 1 ELSE 0 END AS hit FROM ev")
def every_n_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("seq") < 2, 3).otherwise(2)
    return sampling.every_n(event_stream(spark, sf_dir).withColumn("hit", F.lit(0)), {"hit": F.lit(1)}, n, slices="slice").select("stream_id", "seq", "hit")


@query(
    "every_n_failure",
    """WITH {ev} SELECT stream_id, seq, CASE WHEN seq % 2 > 0 OR k % 5 = 0 THEN k WHEN event_type = 'error' THEN k + 1 ELSE (k + 1) * 10 END AS v FROM ev""",
)
def every_n_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = sampling.chain_until_failure([lambda v: v + 1, lambda v: v * 10], [F.col("k") % 5 == 0, IS("error")], F.col("k"))
    rows = event_stream(spark, sf_dir).withColumn("v", F.col("k"))
    return sampling.every_n(rows, {"v": inner}, 2, slices="slice").select("stream_id", "seq", "v")


@query(
    "run_once",
    """WITH {ev}, f AS (SELECT *, min(CASE WHEN event_type <> 'error' THEN seq END) OVER (PARTITION BY stream_id) AS f FROM ev)
       SELECT stream_id, seq, CASE WHEN seq = f THEN -value ELSE value END AS value FROM f""",
)
def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir)
    return sampling.run_once(rows, {"value": -F.col("value")}, fails=IS("error")).select("stream_id", "seq", "value")


@query(
    "run_once_many",
    """WITH {ev} SELECT stream_id, seq, unnest(CASE WHEN seq = 0 THEN range(k % 3) ELSE [NULL::BIGINT] END) AS part FROM ev""",
)
def run_once_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda x: x < F.col("k") % 3)
    return sampling.run_once_many(event_stream(spark, sf_dir), parts, "part").select("stream_id", "seq", "part")


_TAP = """WITH RECURSIVE {ev}, r AS (
         SELECT stream_id, seq, true AS taken, at_us + service_us AS free FROM ev WHERE seq = 0
         UNION ALL
         SELECT e.stream_id, e.seq, e.at_us >= r.free, CASE WHEN e.at_us >= r.free THEN e.at_us + e.service_us ELSE r.free END
         FROM r JOIN ev e ON e.stream_id = r.stream_id AND e.seq = r.seq + 1)
       SELECT stream_id, seq, taken FROM r"""


@query("tap_skip_if_busy", _TAP)
def tap_skip_if_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(event_stream(spark, sf_dir), replay.busy_skip, "seq long, taken boolean", start=lambda: None)


@query("tap_skip_in_runs", _TAP)
def tap_skip_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the parts of a stream between idle gaps."""
    rows = event_stream(spark, sf_dir)
    return replay.replay_runs(rows, replay.busy_skip, "seq long, taken boolean", F.col("at_us") + F.col("service_us"), start=lambda: None, slices="slice")


@query(
    "deadline_async",
    """WITH RECURSIVE {ev}, p AS (SELECT *, event_type = 'error' AS failed,
         CASE WHEN event_type = 'view' THEN k * 720000000 END AS rel, 72000000000 AS lim FROM ev),
       s AS (SELECT stream_id, seq, at_us AS clock, at_us AS free, at_us, service_us, failed, rel, lim FROM p WHERE seq = 0),
       r AS (
         SELECT stream_id, seq,
                CASE WHEN service_us <= lim THEN CASE WHEN failed THEN 'error' ELSE 'completed' END ELSE 'timeout' END AS outcome,
                CASE WHEN service_us <= lim THEN true ELSE coalesce(rel <= lim, false) END AS emitted,
                CASE WHEN service_us <= lim THEN clock + service_us ELSE clock + lim END AS clock, clock + service_us AS free FROM s
         UNION ALL
         SELECT p.stream_id, p.seq,
                CASE WHEN c < r.free THEN 'busy' WHEN p.service_us <= lim THEN CASE WHEN failed THEN 'error' ELSE 'completed' END ELSE 'timeout' END,
                CASE WHEN c < r.free OR p.service_us <= lim THEN true ELSE coalesce(rel <= lim, false) END,
                CASE WHEN c < r.free THEN c WHEN p.service_us <= lim THEN c + p.service_us ELSE c + lim END,
                CASE WHEN c < r.free THEN r.free ELSE c + p.service_us END
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1, LATERAL (SELECT greatest(r.clock, p.at_us) AS c) x)
       SELECT stream_id, seq, outcome, emitted FROM r""",
)
def deadline_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("failed", IS("error"))
    rows = rows.withColumn("released_after_us", F.when(IS("view"), F.col("k") * (HOUR // 5)))
    return replay.replay(rows, replay.deadline(20 * HOUR), "seq long, outcome string, emitted boolean", start=lambda: None)


@query(
    "deadline_stages",
    """WITH RECURSIVE {ev}, p AS (SELECT stream_id, seq, at_us, service_us // 2 AS s1, service_us - service_us // 2 AS s2, event_type = 'error' AS failed, event_type = 'signup' AS dropped,
         event_type = 'purchase' AND k % 10 = 0 AS fatal, CASE WHEN event_type = 'view' THEN k * 720000000 END AS rel, 72000000000 AS lim, CASE WHEN k % 2 = 0 THEN 18000000000 ELSE 0 END AS late FROM ev),
       r AS (
         SELECT DISTINCT stream_id, -1::BIGINT AS seq, NULL::VARCHAR AS outcome, false AS emitted, NULL::BIGINT AS clock, NULL::BIGINT AS free, NULL::BIGINT AS dies FROM p
         UNION ALL
         SELECT p.stream_id, p.seq, o.outcome, coalesce(CASE o.outcome WHEN 'busy' THEN true WHEN 'completed' THEN true WHEN 'error' THEN true WHEN 'timeout' THEN o.passes WHEN 'partial' THEN o.passes ELSE false END, false),
                CASE WHEN o.outcome IN ('busy', 'ended') THEN x.c WHEN t.done <= x.c + p.lim THEN t.done ELSE x.c + p.lim + p.late END,
                CASE WHEN o.outcome IN ('busy', 'ended') THEN coalesce(r.free, p.at_us) ELSE t.done END,
                CASE WHEN o.outcome NOT IN ('busy', 'ended') AND t.whole AND p.fatal THEN t.done ELSE r.dies END
         FROM r JOIN p ON p.stream_id = r.stream_id AND p.seq = r.seq + 1,
              LATERAL (SELECT greatest(coalesce(r.clock, p.at_us), p.at_us) AS c) x,
              LATERAL (SELECT p.s1 < p.lim AS whole, x.c + p.s1 + CASE WHEN p.s1 < p.lim THEN p.s2 ELSE 0 END AS done) t,
              LATERAL (SELECT CASE WHEN x.c >= r.dies THEN 'ended' WHEN x.c < r.free THEN 'busy' WHEN t.whole AND p.fatal AND t.done <= x.c + p.lim + p.late THEN 'fatal'
                              WHEN NOT t.whole THEN 'partial' WHEN t.done > x.c + p.lim THEN 'timeout' WHEN p.failed THEN 'error' WHEN p.dropped THEN 'dropped' ELSE 'completed' END AS outcome,
                              t.done <= x.c + p.lim + p.late OR coalesce(x.c + p.rel <= x.c + p.lim + p.late, false) AS passes) o)
       SELECT stream_id, seq, outcome, emitted FROM r WHERE seq >= 0""",
)
def deadline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.floor(F.col("service_us") / 2)
    rows = event_stream(spark, sf_dir).withColumns(
        {
            "stages_us": F.array(first, F.col("service_us") - first), "failed": IS("error"), "dropped": IS("signup"), "fatal": IS("purchase") & (F.col("k") % 10 == 0),
            "check_us": F.when(F.col("k") % 2 == 0, 5 * HOUR).otherwise(0), "frame_released_after_us": F.when(IS("view"), F.col("k") * (HOUR // 5)), "released_after_us": F.lit(0),
        }
    )
    return replay.replay(rows, replay.deadline(20 * HOUR), "seq long, outcome string, emitted boolean", start=lambda: None)


@query("drop_protocol", "WITH {ev} SELECT stream_id, seq, (k + 1) * 100 // (k % 4) AS v FROM ev WHERE k % 4 > 0 AND k % 3 > 0")
def drop_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    # the second step cannot take what the first drops
    divide = lambda v: F.when(k % 4 == 0, F.raise_error(F.lit("a dropped row went on")).cast("long")).otherwise(F.floor(v * 100 / (k % 4)))
    value, gone = sampling.chain_with_drops([lambda v: v + 1, divide, lambda v: v], [lambda v: k % 4 == 0, lambda v: k % 3 == 0, lambda v: F.lit(False)], k)
    rows = event_stream(spark, sf_dir).withColumns({"v": value, "outcome": F.when(gone, "dropped").otherwise("completed")})
    return recovery.without_dropped(rows).select("stream_id", "seq", "v")


@query(
    "nested_steps",
    """WITH {ev} SELECT stream_id, seq, CASE WHEN seq % 2 > 0 OR k % 5 = 0 THEN k WHEN event_type = 'error' THEN k + 1 WHEN k % 4 = 1 THEN 10 * (k + 1) ELSE 10 * (k + 1) - 3 END AS v
       FROM ev WHERE seq % 2 > 0 OR k % 5 = 0 OR event_type = 'error' OR k % 7 > 0""",
)
def nested_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every second row: a step that fails at some rows, one that fails at others and drops some, one that gives some rows twice or not at all."""

    def careless(df: DataFrame) -> DataFrame:
        copies = F.array_repeat(F.lit(1), F.when(F.col("k") % 4 == 1, F.col("k") % 3 * 2).otherwise(1).cast("int"))
        return df.withColumn("v", F.col("v") - 3).withColumn("copy", F.explode(copies)).drop("copy")

    chain = EveryNFrames(
        Change({"v": "v + 1"}, fails="k % 5 = 0"), Change({"v": "v * 10"}, fails="event_type = 'error'", drops="k % 7 = 0"), Apply(careless), interval_frames=2
    )
    rows = event_stream(spark, sf_dir).withColumn("v", F.col("k"))
    return Pipeline("nested").step(chain).run(rows).select("stream_id", "seq", "v")


@query(
    "pass_through_on_error",
    "WITH {ev} SELECT stream_id, seq, CASE WHEN event_type <> 'error' THEN value * 10 END AS model_output, value FROM ev",
)
def pass_through_on_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recovery.pass_through(event_stream(spark, sf_dir), IS("error"), {"model_output": F.col("value") * 10})
    return rows.select("stream_id", "seq", "model_output", "value")


@query(
    "fatal_classify",
    """WITH {ev} SELECT stream_id, seq, k % 5 IN (0, 2, 3) AS fatal FROM ev""",
)
def fatal_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 5
    message = F.when(k == 0, "CUDA error: misaligned address").when(k == 1, "no route").when(k == 4, F.lit(None)).otherwise("inference failed")
    cause = F.when(k == 2, "an Illegal Memory Access was met").otherwise("")
    kinds = (F.lit("RuntimeError"), F.when(k == 3, "MemoryError"))
    return event_stream(spark, sf_dir).select("stream_id", "seq", recovery.is_fatal(message, cause, types=kinds).alias("fatal"))


@query(
    "hotswap_epochs",
    """WITH {ev}, e AS (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS a, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER w AS b FROM ev
         WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
       SELECT stream_id, seq, '0.' || a AS first_tag, '0.' || a || '/1.' || b AS second_tag, row_number() OVER (PARTITION BY stream_id, a, b ORDER BY seq) - 1 AS index FROM e""",
)
def hotswap_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = gating.epoch_tags([IS("purchase"), IS("signup")])
    text = lambda tag: F.array_join(F.transform(tag, lambda t: F.concat_ws(".", t["slot"].cast("string"), t["revision"].cast("string"))), "/")
    rows = event_stream(spark, sf_dir).withColumns({"first_tag": text(first), "second_tag": text(second)})
    # the second step counts its inputs; it is made anew at a change of its own or of the step before it
    index = F.row_number().over(Window.partitionBy("stream_id", "second_tag").orderBy("seq")) - 1
    return rows.select("stream_id", "seq", "first_tag", "second_tag", index.cast("long").alias("index"))


@query(
    "hotswap_pass_through",
    "WITH {ev} SELECT stream_id, seq, CASE WHEN event_type = 'error' THEN k ELSE (k + 1) * 2 END AS v FROM ev",
)
def hotswap_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("v", F.col("k"))
    return recovery.pass_through(rows, IS("error"), {"v": (F.col("v") + 1) * 2}).select("stream_id", "seq", "v")


#: Batches of four, of one kind each, that wait 40 hours at most and take ten.
_BATCHES = """WITH RECURSIVE {ev},
       r AS (
         SELECT DISTINCT stream_id, 0::BIGINT AS nxt, NULL::BIGINT AS free, []::BIGINT[] AS off, false AS open, 0 AS size, NULL::VARCHAR AS key,
                NULL::BIGINT AS now, NULL::BIGINT AS last, -1::BIGINT AS batch, NULL::BIGINT AS seq, NULL::BIGINT AS place, NULL::BIGINT AS closed FROM ev
         UNION ALL
         SELECT r.stream_id,
                CASE WHEN seed THEN CASE WHEN len(r.off) > 0 THEN r.nxt ELSE r.nxt + 1 END WHEN pull THEN r.nxt + 1 ELSE r.nxt END,
                CASE WHEN seed OR pull THEN r.free ELSE ended + 36000000000 END,
                CASE WHEN seed THEN r.off[2:] WHEN pull AND a.event_type <> r.key THEN list_append(r.off, r.nxt) ELSE r.off END,
                seed OR pull,
                CASE WHEN seed THEN 1 WHEN pull AND a.event_type = r.key THEN r.size + 1 ELSE r.size END,
                CASE WHEN seed THEN f.event_type ELSE r.key END,
                CASE WHEN seed THEN greatest(coalesce(r.free, f.at_us), f.at_us) WHEN pull THEN greatest(r.now, a.at_us) ELSE r.now END,
                CASE WHEN seed THEN f.at_us + 144000000000 ELSE r.last END,
                CASE WHEN seed THEN r.batch + 1 ELSE r.batch END,
                CASE WHEN seed THEN f.seq WHEN pull AND a.event_type = r.key THEN a.seq END,
                CASE WHEN seed THEN 0 WHEN pull AND a.event_type = r.key THEN r.size END,
                CASE WHEN NOT seed AND NOT pull THEN ended END
         FROM r LEFT JOIN ev a ON a.stream_id = r.stream_id AND a.seq = r.nxt
                LEFT JOIN ev f ON f.stream_id = r.stream_id AND f.seq = coalesce(r.off[1], r.nxt),
              LATERAL (SELECT NOT r.open AS seed, r.open AND r.size < 4 AND coalesce(a.at_us <= greatest(r.now, r.last), false) AS pull,
                              CASE WHEN r.size < 4 THEN greatest(r.now, r.last) ELSE r.now END AS ended) t
         WHERE r.open OR f.seq IS NOT NULL),
       c AS (SELECT stream_id, batch, closed FROM r WHERE closed IS NOT NULL)"""


@query(
    "batch_collect",
    _BATCHES
    + " SELECT r.stream_id, r.seq, r.batch, r.place, c.closed AS closed_us FROM r JOIN c USING (stream_id, batch) WHERE r.seq IS NOT NULL",
)
def batch_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("key", F.col("event_type"))
    return batching.collect_batches(rows, 4, 40 * HOUR, 10 * HOUR)


def shared_sum(kind: str) -> Callable:
    """A model whose rows feel the others of their call: each plus 1000 times the sum of all; sums of sevens fail."""

    def infer(rows):
        whole = rows.sum()
        if whole % 7 == 0:
            raise ValueError(f"{kind}: {int(whole)}")
        return rows + 1000 * whole

    return infer


@query(
    "inference_batches",
    _BATCHES
    + """, m AS (SELECT r.stream_id, r.seq, r.batch, r.place, c.closed, e.k, e.event_type, sum(e.k) OVER (PARTITION BY r.stream_id, r.batch) AS whole
         FROM r JOIN c USING (stream_id, batch) JOIN ev e ON e.stream_id = r.stream_id AND e.seq = r.seq WHERE r.seq IS NOT NULL)
       SELECT stream_id, seq, batch, place, closed AS closed_us, CASE WHEN whole % 7 > 0 THEN (k + 1000 * whole)::DOUBLE END AS output,
              CASE WHEN whole % 7 = 0 THEN 'ValueError: ' || event_type || ': ' || whole::BIGINT::VARCHAR END AS error FROM m""",
)
def inference_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumns({"key": F.col("event_type"), "rows": F.array(F.array(F.col("k").cast("double")))})
    found = inference.infer_batches(rows, shared_sum, size=4, wait_us=40 * HOUR, service_us=10 * HOUR)
    return found.withColumn("output", F.get(F.get("outputs", F.lit(0)), F.lit(0))).drop("outputs")


@query(
    "batch_key",
    """WITH {ev} SELECT stream_id, seq, '{"backend":"' || event_type || '","gpu":' || (k % 2)::VARCHAR || ',"profile":0,"inputs":[{"name":"a","dtype":"float16","axes":[' || (k % 3 + 1)::VARCHAR
         || ']},{"name":"b,c:d","dtype":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '"float32"' END || ',"axes":[2,2]},{"name":"c","dtype":"int8","axes":[]}]}' AS key FROM ev""",
)
def batch_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tensor = lambda t, *s: F.struct(t.alias("dtype"), F.array(*s).alias("shape"))
    side = (F.col("k") % 3 + 1).cast("int")
    inputs = F.create_map(
        F.lit("b,c:d"), tensor(F.when(F.col("k") % 4 > 0, "float32"), F.lit(1), F.lit(2), F.lit(2)), F.lit("a"), tensor(F.lit("float16"), F.lit(1), side), F.lit("c"), tensor(F.lit("int8"), F.lit(5))
    )
    key = batching.batch_key(F.col("event_type"), F.col("k") % 2, F.lit(0), inputs)
    return event_stream(spark, sf_dir).select("stream_id", "seq", key.alias("key"))


@query(
    "batch_split",
    """WITH {ev}, b AS (SELECT *, seq // 4 AS batch, k % 3 + 1 AS n FROM ev),
       s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stream_id, batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY stream_id, batch) AS whole FROM b)
       SELECT stream_id, batch, seq, unnest(CASE WHEN whole % 5 > 0 THEN list_transform(range(n), lambda i: round(2 * (value + i), 4)) ELSE [NULL] END) AS output,
              CASE WHEN whole % 5 = 0 THEN 'outputs for ' || whole::BIGINT || ' inputs are not as many' END AS error FROM s""",
)
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = (F.col("k") % 3).cast("int")
    inputs = F.transform(F.sequence(F.lit(0), count), lambda i: F.col("value") + i)
    rows = event_stream(spark, sf_dir).withColumns({"batch": F.floor(F.col("seq") / 4), "rows": inputs})
    whole = batching.concatenate(rows, "rows", "stream_id", "batch", place="seq")
    # a model that loses a row of every batch of five, ten, ... inputs
    made = F.transform("inputs", lambda x: F.round(x * 2, 4))
    outputs = F.when(F.size("inputs") % 5 == 0, F.slice(made, F.lit(2), F.size("inputs"))).otherwise(made)
    return batching.split(whole, outputs, "stream_id", "batch").select("stream_id", "batch", "seq", F.explode_outer("outputs").alias("output"), "error")


@query(
    "batch_error",
    """WITH {ev} SELECT stream_id, seq, max(CASE WHEN event_type = 'error' THEN 'failed at ' || seq::VARCHAR END) OVER (PARTITION BY stream_id, seq // 4) AS error FROM ev""",
)
def batch_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 4))
    error = F.when(IS("error"), F.concat(F.lit("failed at "), F.col("seq").cast("string")))
    return rows.select("stream_id", "seq", batching.share_in_batch(error, "stream_id", "batch").alias("error"))


@query(
    "batch_timing",
    """WITH {ev} SELECT stream_id, seq, max(at_us) OVER b - at_us AS queue_us, max(service_us) OVER b AS elapsed_us FROM ev
       WINDOW b AS (PARTITION BY stream_id, seq // 4)""",
)
def batch_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 4))
    share = lambda c: batching.share_in_batch(F.col(c), "stream_id", "batch")
    return rows.select("stream_id", "seq", (share("at_us") - F.col("at_us")).alias("queue_us"), share("service_us").alias("elapsed_us"))


@query(
    "model_registry",
    """WITH {ev}, m AS (SELECT event_type AS backend, CASE WHEN k % 3 = 0 THEN '/m/a.pt' WHEN k % 3 = 1 THEN '/w' || (k % 2)::VARCHAR || '/a.pt' ELSE '/b.pt' END AS model, event_id, k % 5 > 0 AS fails FROM ev),
       f AS (SELECT backend, model, min(CASE WHEN NOT fails THEN event_id END) AS made_at, count(*) AS n_requests FROM m GROUP BY ALL)
       SELECT f.backend, f.model, f.made_at, f.n_requests, count(*) FILTER (m.fails AND (f.made_at IS NULL OR m.event_id < f.made_at)) AS n_failed FROM f JOIN m USING (backend, model) GROUP BY ALL""",
)
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    path = F.when(k == 0, "/m/./x/../a.pt").when(k == 1, "a.pt").otherwise("../b.pt")
    model = batching.model_file(path, F.concat(F.lit("/w"), (F.col("k") % 2).cast("string")))
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("backend"), model.alias("model"), "event_id", (F.col("k") % 5 > 0).alias("fails"))
    return batching.registry(rows, "backend", "model", F.col("fails"), order="event_id")
