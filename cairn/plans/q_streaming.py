"""Registered queries: streaming operators run over a file stream of the
tables with ``availableNow`` and compared with the batch SQL (T1-T9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import minhash as MH
from cairn.plans import derived as D
from cairn.plans import views as V
from cairn.plans.oracle import W
from cairn.plans.registry import query
from cairn.streaming import stateful as SF
from cairn.streaming import streams as ST


def r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _events(spark, d):
    return ST.read_table_stream(spark, d, "events")


@query("t1_stream_impressions", W("impressions") + """
SELECT consumer, COALESCE(rectag, 'default') AS rectag, abkey, CAST(floor(t_us / 1000000) AS BIGINT) AS second,
       COUNT(*) FILTER (WHERE click = 'IMP') AS impressions, COUNT(*) FILTER (WHERE click = 'CTR') AS clicks
FROM impressions GROUP BY ALL""")
def q_t1(spark, d):
    s = ST.stream_impressions(V.impressions_of(V.clicks_of(_events(spark, d))))
    return ST.run_to_table(s, ["consumer", "rectag", "abkey", "second"])


@query("t2_stream_requests", """
WITH r AS (SELECT 'c' || CAST(user_id % 3 AS VARCHAR) AS consumer, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS httpmethod,
  CASE event_type WHEN 'view' THEN '/users/{userid}/recommendations' WHEN 'click' THEN '/items/{itemid}/actions'
    WHEN 'purchase' THEN '/users/{userid}/actions/{itemid}' WHEN 'error' THEN '/js/' || json_extract_string(props, '$.k') || '/actions'
    ELSE '/actions/{actionid}' END AS path,
  CAST(floor(value * 10) AS INTEGER) AS exectime, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second FROM events)
SELECT consumer, httpmethod, path, second, COUNT(*) AS count, round(avg(exectime), 6) AS exectime FROM r GROUP BY ALL""")
def q_t2(spark, d):
    reqs = D.requests_of(V.clicks_of(_events(spark, d)))
    out = ST.run_to_table(ST.stream_requests(reqs), ["consumer", "httpmethod", "path", "second"])
    return out.select("consumer", "httpmethod", "path", "second", "count", r("exectime", "exectime"))


@query("t3_stream_predictions", """
WITH p AS (SELECT vec_id, 'c' || CAST(vec_id % 3 AS VARCHAR) AS consumer, CASE WHEN label = 0 THEN 'v0' ELSE 'v1' END AS variation,
                  'm' || CAST(vec_id % 2 AS VARCHAR) AS model, CAST(vec_id * 10 AS BIGINT) AS time,
                  [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS s FROM embeddings),
x AS (SELECT p.*, u.i, u.v FROM p, LATERAL (SELECT unnest(s) AS v, generate_subscripts(s, 1) AS i) u),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rn FROM x)
SELECT consumer, variation, model, CASE i WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS predicted_class, time AS second,
       COUNT(*) AS count, round(avg(v), 6) AS score FROM b WHERE rn = 1 GROUP BY ALL""")
def q_t3(spark, d):
    preds = D.predictions_of(ST.read_table_stream(spark, d, "embeddings"))
    out = ST.run_to_table(ST.stream_predictions(preds), ["consumer", "variation", "model", "predicted_class", "second"])
    return out.select("consumer", "variation", "model", "predicted_class", "second", "count", r("score", "score"))


@query("t4_stream_popularity", W("clicks") + """
SELECT item_id, CAST(COUNT(*) AS DOUBLE) AS score, (SELECT CAST(floor(max(t_us) / 1000000) AS BIGINT) FROM clicks) AS t
FROM clicks GROUP BY item_id""")
def q_t4(spark, d):
    import uuid
    from cairn.session import ensure_checkpoint_dir
    state = f"{ensure_checkpoint_dir(spark)}/popularity/{uuid.uuid4().hex}"
    c = V.clicks_of(_events(spark, d)).withColumn("t", F.floor(F.col("t_us") / 1_000_000).cast("bigint"))
    fn = lambda b, i: ST.stream_popularity_batch(b, state, i)
    out = ST.run_to_table(c.select("item_id", "t"), ["item_id"], mode="append", batch_fn=fn)
    return out.select("item_id", "score", "t")


WEEK = 7 * 86400
MH_H, MH_SEED, MH_MIN = 20, 7, 20


def _mh_sql() -> str:
    co = ", ".join(f"({j}, {a}, {b})" for j, (a, b) in enumerate(MH.coefficients(MH_H, MH_SEED)))
    return W("clicks") + f""",
cf(j, a, b) AS (VALUES {co}),
ev AS (SELECT CAST(floor(t_us / 1e6 / {WEEK}) * {WEEK} AS BIGINT) AS wstart, item_id AS item, user_id % 4294967296 AS x FROM clicks),
act AS (SELECT wstart, item FROM ev GROUP BY ALL HAVING COUNT(*) >= {MH_MIN}),
sg AS (SELECT ev.wstart, ev.item, cf.j, min((cf.a * ev.x + cf.b) % {MH.PRIME}) AS v FROM ev JOIN act USING (wstart, item), cf GROUP BY ALL),
pr AS (SELECT a.wstart, a.item AS item1, b.item AS item2, COUNT(*) AS co FROM sg a JOIN sg b
       ON a.wstart = b.wstart AND a.j = b.j AND a.v = b.v AND a.item < b.item GROUP BY ALL)
SELECT wstart, item1, item2, round(co / {float(MH_H)}, 6) AS jaccard FROM pr"""


@query("t5_minhash_similarity", _mh_sql())
def q_t5(spark, d):
    c = V.clicks(spark, d).withColumn("t", F.col("t_us") / 1e6)
    out = MH.minhash_similarity(c, WEEK, MH_H, MH_SEED, MH_MIN, chunk=8)
    return out.select(F.col("window").alias("wstart"), "item1", "item2", r("jaccard", "jaccard"))


@query("t5_minhash_similarity_stream", _mh_sql())
def q_t5s(spark, d):
    """Signatures maintained by a streaming window aggregation (state = one
    row of h minima per window and item); pairs computed on the result."""
    c = V.clicks_of(_events(spark, d))
    x = F.pmod(F.col("user_id"), F.lit(1 << 32))
    hs = [F.pmod(F.lit(a) * x + F.lit(b), F.lit(MH.PRIME)) for a, b in MH.coefficients(MH_H, MH_SEED)]
    agg = (c.withWatermark("ts", "1 day").groupBy(F.window("ts", "7 days").alias("w"), F.col("item_id").alias("item"))
           .agg(F.count(F.lit(1)).alias("activity"), *[F.min(h).alias(f"_m{j}") for j, h in enumerate(hs)])
           .select(F.unix_timestamp(F.col("w.start")).alias("window"), "item", "activity",
                   F.array(*[F.col(f"_m{j}") for j in range(MH_H)]).alias("sig")))
    sig = ST.run_to_table(agg, ["window", "item"]).filter(F.col("activity") >= MH_MIN)
    from cairn.operators.similarity import co_occurrence
    ex = sig.select("window", "item", F.posexplode("sig").alias("j", "v"))
    co = co_occurrence(ex, chunk=8, key=["window", "j", "v"], item="item", group=("window",))
    return co.select(F.col("window").alias("wstart"), "item1", "item2", r(F.col("co") / float(MH_H), "jaccard"))


ALPHA = 7 * 86400.0


@query("t6_stream_decayed_counts", W("clicks") + f""",
m AS (SELECT item_id, max(t_us / 1e6) AS mt FROM clicks GROUP BY item_id)
SELECT c.item_id AS key, round(SUM(exp(-(m.mt - c.t_us / 1e6) / {ALPHA})), 6) AS count, CAST(floor(m.mt) AS BIGINT) AS last_t
FROM clicks c JOIN m ON c.item_id = m.item_id GROUP BY c.item_id, m.mt""")
def q_t6(spark, d):
    c = V.clicks_of(_events(spark, d)).withColumn("t", F.col("t_us") / 1e6)
    out = ST.run_to_table(ST.stream_decayed_counts(c, "item_id", ALPHA), ["key"])
    return out.select("key", r("count", "count"), F.floor("last_t").cast("bigint").alias("last_t"))


@query("t7_event_time", """
SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS from_utc, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS from_epoch FROM events""")
def q_t7(spark, d):
    e = V.table(spark, d, "events")
    j = e.select("event_id", F.concat(F.lit('{"timestamp_utc": "'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                                      F.lit('", "time": '), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"),
                                      F.lit("}")).alias("json"))
    a = ST.with_event_time(j, "json", "json_utc").select("event_id", F.unix_timestamp("event_time").alias("from_utc"))
    b = ST.with_event_time(j, "json", "json_epoch").select("event_id", F.unix_timestamp("event_time").alias("from_epoch"))
    return a.join(b, "event_id")


@query("t8_split_by_tag", "SELECT event_type AS flow, event_id FROM events WHERE event_type IN ('view', 'click')")
def q_t8(spark, d):
    flows = ST.split_by_tag(_events(spark, d), "event_type", ["view", "click"])
    outs = [ST.run_to_table(f.select(F.lit(tag).alias("flow"), "event_id"), None, mode="append") for tag, f in flows.items()]
    return outs[0].unionByName(outs[1])


GAP6 = 6 * 3600 * 1_000_000


@query("t9_stream_sessions", W("clicks") + f""",
g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS gp FROM clicks),
s AS (SELECT *, SUM(CASE WHEN gp IS NULL OR gp >= {GAP6} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id
        ROWS UNBOUNDED PRECEDING) AS sn FROM g)
SELECT user_id, min(t_us) AS start_us, max(t_us) + {GAP6} AS end_us, COUNT(*) AS n FROM s GROUP BY user_id, sn""")
def q_t9(spark, d):
    # complete mode so the availableNow run also returns the sessions the
    # watermark has not closed yet; a long-running job uses append mode
    s = ST.stream_sessions(V.clicks_of(_events(spark, d)), "6 hours")
    return ST.run_to_table(s, None, mode="complete")


# ---- the table arrives in four slices; state and watermark carry over ----

SLICES = 4
SLICED = f"""
span AS (SELECT min(t_us) AS first, (max(t_us) - min(t_us)) // {SLICES} + 1 AS step FROM ALLROWS)"""


@query("t4_stream_popularity_slices", W("clicks") + "," + SLICED.replace("ALLROWS", "clicks") + """,
b AS (SELECT item_id, (t_us - first) // step AS b, CAST(floor(t_us / 1000000) AS BIGINT) AS t FROM clicks, span),
e AS (SELECT b, max(t) AS now FROM b GROUP BY b),
c AS (SELECT b.item_id, e.now, COUNT(*) AS n FROM b JOIN e ON e.b = b.b GROUP BY ALL),
m AS (SELECT item_id, max(now) AS last FROM c GROUP BY item_id)
SELECT c.item_id, round(SUM(c.n * exp(-(m.last - c.now) / 82400.0)), 6) AS score, m.last AS t
FROM c JOIN m ON m.item_id = c.item_id GROUP BY c.item_id, m.last""")
def q_t4_slices(spark, d):
    """Every slice is merged into the decayed popularity that the slices before it left."""
    import uuid
    from cairn.session import ensure_checkpoint_dir
    state = f"{ensure_checkpoint_dir(spark).rstrip('/')}/popularity/{uuid.uuid4().hex}"
    build = lambda e: V.clicks_of(e).select("item_id", F.floor(F.col("t_us") / 1_000_000).cast("bigint").alias("t"))
    out = SF.run_in_slices(V.table(spark, d, "events"), "ts", build, SLICES, keys=["item_id"],
                           batch_fn=lambda b, i: ST.stream_popularity_batch(b, state, i))
    return out.select("item_id", r("score", "score"), "t")


DAY = 86400


def _rolling_sql() -> str:
    co = ", ".join(f"({j}, {a}, {b})" for j, (a, b) in enumerate(MH.coefficients(MH_H, MH_SEED)))
    return W("clicks") + f""",
cf(j, a, b) AS (VALUES {co}),
ev AS (SELECT (t_us + {DAY * 1_000_000 - 1}) // {DAY * 1_000_000} * {DAY} AS step, item_id AS item, user_id % 4294967296 AS x FROM clicks),
st AS (SELECT step, item, COUNT(*) AS n FROM ev GROUP BY ALL),
sm AS (SELECT ev.step, ev.item, cf.j, min((cf.a * ev.x + cf.b) % {MH.PRIME}) AS v FROM ev, cf GROUP BY ALL),
act AS (SELECT step + k.d * {DAY} AS wend, item FROM st, (SELECT unnest(range(0, 7)) AS d) k GROUP BY ALL HAVING sum(n) >= {MH_MIN}),
sg AS (SELECT act.wend, sm.item, sm.j, min(sm.v) AS v FROM sm JOIN act ON act.item = sm.item AND sm.step > act.wend - {WEEK} AND sm.step <= act.wend GROUP BY ALL),
pr AS (SELECT a.wend, a.item AS item1, b.item AS item2, COUNT(*) AS co FROM sg a JOIN sg b
       ON a.wend = b.wend AND a.j = b.j AND a.v = b.v AND a.item < b.item GROUP BY ALL)
SELECT CAST(wend AS BIGINT) AS window_end, item1, item2, round(co / {float(MH_H)}, 6) AS jaccard FROM pr"""


@query("t5_minhash_rolling", _rolling_sql())
def q_t5_rolling(spark, d):
    """Similar items over the last seven days, at the end of every day."""
    build = lambda e: SF.stream_rolling_minhash(V.clicks_of(e), WEEK, DAY, MH_H, MH_SEED, MH_MIN)
    sig = SF.run_in_slices(V.table(spark, d, "events"), "ts", build, SLICES, close_after_s=9 * DAY)
    out = SF.signature_similarity(sig, MH_H)
    return out.select(F.col("at").alias("window_end"), "item1", "item2", r("jaccard", "jaccard"))


IDLE = 12 * 3600


@query("t6_stream_decayed_runs", W("clicks") + f""",
g AS (SELECT item_id, t_us, event_id, t_us - lag(t_us) OVER (PARTITION BY item_id ORDER BY t_us, event_id) AS gap FROM clicks),
s AS (SELECT *, SUM(CASE WHEN gap > {IDLE * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
m AS (SELECT item_id, run, min(t_us) AS begin_us, max(t_us) AS last_us FROM s GROUP BY ALL)
SELECT s.item_id AS key, m.begin_us, m.last_us, COUNT(*) AS n, round(SUM(exp(-(m.last_us - s.t_us) / 1e6 / {ALPHA})), 6) AS count
FROM s JOIN m ON m.item_id = s.item_id AND m.run = s.run GROUP BY s.item_id, m.run, m.begin_us, m.last_us""")
def q_t6_runs(spark, d):
    """Decayed counts of items, dropped after twelve hours without an event."""
    build = lambda e: SF.stream_decayed_runs(V.clicks_of(e), "item_id", ALPHA, IDLE)
    out = SF.run_in_slices(V.table(spark, d, "events"), "ts", build, SLICES, close_after_s=2 * DAY)
    return out.select("key", "begin_us", "last_us", "n", r("count", "count"))


@query("t9_stream_sessions_append", W("clicks") + f""",
g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS gp FROM clicks),
s AS (SELECT *, SUM(CASE WHEN gp IS NULL OR gp >= {GAP6} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id
        ROWS UNBOUNDED PRECEDING) AS sn FROM g)
SELECT user_id, min(t_us) AS start_us, max(t_us) + {GAP6} AS end_us, COUNT(*) AS n FROM s GROUP BY user_id, sn""")
def q_t9_append(spark, d):
    """Sessions as the watermark closes them, each once; those left open at the end of a slice go on in the next."""
    build = lambda e: ST.stream_sessions(V.clicks_of(e), "6 hours")
    return SF.run_in_slices(V.table(spark, d, "events"), "ts", build, SLICES, close_after_s=2 * DAY)
