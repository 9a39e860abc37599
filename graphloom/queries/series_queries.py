"""Queries on time, series, arrays and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import numeric, temporal
from graphloom.operators import corpus, profiles, series
from graphloom.queries.registry import query
from graphloom.session import table
from graphloom.sources import readers

DAILY = """(SELECT 'U' || user_id AS ticker, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close, max(value) AS high, min(value) AS low, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """Daily prices of the event table: a user is a ticker, its last value of a day the close."""
    e = table(spark, d, "events").where("value is not null")
    return e.groupBy(F.concat(F.lit("U"), "user_id").alias("ticker"), F.to_date("ts").alias("Date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("Close"), F.max("value").alias("High"), F.min("value").alias("Low"), F.count("*").alias("Volume"))


@query("SELECT event_id, CASE WHEN isodow(ts) >= 6 THEN 'closed' WHEN hour(ts) * 60 + minute(ts) < 555 THEN 'pre_market' WHEN hour(ts) * 60 + minute(ts) < 930 THEN 'regular' ELSE 'post_market' END AS session FROM events")
def d2_market_session(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", temporal.market_session(F.col("ts")).alias("session"))


@query("SELECT event_id, strftime(CASE isodow(ts) WHEN 6 THEN ts::DATE + 2 WHEN 7 THEN ts::DATE + 1 ELSE ts::DATE END, '%Y-%m-%d') AS day FROM events")
def d3_trading_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format(temporal.trading_day(F.col("ts")), "yyyy-MM-dd").alias("day"))


LOOSE = """(SELECT event_id, CASE event_id % 11 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 3 THEN strftime(ts, '%d-%m-%Y') WHEN 4 THEN strftime(ts, '%d/%m/%Y')
  WHEN 5 THEN strftime(ts, '%Y-%m-%d') || ' to 2030-01-01' WHEN 6 THEN 'unknown' WHEN 7 THEN strftime(ts, '%Y') WHEN 8 THEN strftime(ts, '%Y-%m') WHEN 9 THEN 'prior to ' || strftime(ts, '%Y-%m-%d') || ' or so' ELSE 'near term' END AS loose, ts FROM events)"""


@query(f"""SELECT event_id, CASE event_id % 11 WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 6 THEN NULL WHEN 10 THEN NULL WHEN 7 THEN strftime(ts, '%Y-01-01 00:00:00') WHEN 8 THEN strftime(ts, '%Y-%m-01 00:00:00') ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed FROM {LOOSE}""")
def d1_tolerant_dates(spark: SparkSession, d: str) -> DataFrame:
    f = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 11
    loose = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, f("yyyy-MM-dd HH:mm")).when(k == 3, f("dd-MM-yyyy")).when(k == 4, f("dd/MM/yyyy"))
    loose = loose.when(k == 5, F.concat(f("yyyy-MM-dd"), F.lit(" to 2030-01-01"))).when(k == 6, "unknown").when(k == 7, f("yyyy")).when(k == 8, f("yyyy-MM")).when(k == 9, F.concat(F.lit("prior to "), f("yyyy-MM-dd"), F.lit(" or so"))).otherwise("near term")
    return table(spark, d, "events").select("event_id", F.date_format(temporal.tolerant_timestamp(loose), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT edge_no, (epoch(date_trunc('second', temporal.t_effective))::BIGINT - epoch(date_trunc('second', temporal.t_announce))::BIGINT)::BIGINT AS seconds FROM relationships")
def d4_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationships").select("edge_no", temporal.duration_seconds(F.col("temporal.t_announce"), F.col("temporal.t_effective")).alias("seconds"))


@query("SELECT edge_no, list_aggregate(list_transform(list_sort(list_distinct([temporal.t_observe, created_at, created_at])), lambda x: strftime(x, '%Y-%m-%d %H:%M:%S')), 'string_agg', ',') AS seen FROM relationships WHERE temporal.t_observe IS NOT NULL AND created_at IS NOT NULL")
def d5_observations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships").where("temporal.t_observe is not null and created_at is not null")
    seen = temporal.add_observation(F.array("created_at", "temporal.t_observe"), F.col("created_at"))
    return r.select("edge_no", F.array_join(F.transform(seen, lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")), ",").alias("seen"))


@query("""SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' ELSE (m // 60 // 24) || 'd ago' END AS label
FROM (SELECT event_id, (epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - epoch(date_trunc('second', ts))::BIGINT) // 60 AS m FROM events)""")
def d7_relative_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", temporal.relative_label(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("label"))


@query("SELECT edge_no, CASE WHEN props.sentiment > 0.2 THEN 'positive' WHEN props.sentiment < -0.2 THEN 'negative' ELSE 'neutral' END AS bucket, (round(least(greatest(props.sentiment, 0), 1), 4) + 0.0)::DOUBLE AS clamped FROM relationships WHERE props.sentiment IS NOT NULL")
def d8_buckets(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("props.sentiment")
    return table(spark, d, "relationships").where(s.isNotNull()).select("edge_no", numeric.sentiment_bucket(s).alias("bucket"), (F.round(numeric.clamp(s), 4) + 0.0).alias("clamped"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4)::DOUBLE AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def d9_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("other"))  # one row
    return e.join(F.broadcast(one)).select("vec_id", F.round(numeric.cosine(F.col("embedding"), F.col("other")), 4).alias("similarity"))


@query("SELECT vec_id, round(exp(embedding[1]::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6)::DOUBLE AS p1, round(embedding[1]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6)::DOUBLE AS lp1, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def d10_softmax(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(numeric.softmax(v)[0], 6).alias("p1"), F.round(numeric.log_softmax(v)[0], 6).alias("lp1"), numeric.top_k_indices(v, 1)[0].cast("long").alias("best"))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC, close DESC) AS rn FROM {DAILY}), s AS (SELECT ticker, arg_min(close, rn) AS latest, arg_max(close, rn) AS first, max(high) AS high, min(low) AS low, avg(volume) AS v FROM t WHERE rn <= 30 GROUP BY ticker)
SELECT ticker, round(latest, 4)::DOUBLE AS latest, round(first, 4)::DOUBLE AS first, round(high, 4)::DOUBLE AS high, round(low, 4)::DOUBLE AS low, round(v, 4)::DOUBLE AS avg_volume, round((latest - first) / first * 100, 4)::DOUBLE AS change_pct FROM s""")
def a7_stock_summary(spark: SparkSession, d: str) -> DataFrame:
    s = series.summary(_prices(spark, d))
    return s.select("ticker", *[F.round(c, 4).alias(c) for c in ("latest", "first", "high", "low", "avg_volume", "change_pct")])


@query(f"SELECT ticker, count(*)::BIGINT AS n, strftime(min(day), '%Y-%m-%d') AS first_date, strftime(max(day), '%Y-%m-%d') AS last_date, round(arg_max(close, day), 4)::DOUBLE AS last_close FROM {DAILY} GROUP BY ticker")
def a15_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = series.coverage(_prices(spark, d))
    return c.select("ticker", "n", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), F.round("last_close", 4).alias("last_close"))


@query(f"SELECT ticker, round(close, 4)::DOUBLE AS close, 0::DOUBLE AS open, volume::DOUBLE AS volume FROM {DAILY} WHERE day = DATE '2024-01-10' AND ticker = 'U5'")
def f19_price_on_date(spark: SparkSession, d: str) -> DataFrame:
    return series.price_on(_prices(spark, d), "U5", "2024-01-10").select("ticker", F.round("close", 4).alias("close"), "open", "volume")


@query(f"SELECT ticker, round((max(close) FILTER (day = DATE '2024-01-20') - max(close) FILTER (day = DATE '2024-01-05')) / nullif(max(close) FILTER (day = DATE '2024-01-05'), 0) * 100, 4)::DOUBLE AS change_pct FROM {DAILY} GROUP BY ticker")
def j12_price_change(spark: SparkSession, d: str) -> DataFrame:
    return series.change_between(_prices(spark, d), "2024-01-05", "2024-01-20").select("ticker", F.round("change_pct", 4).alias("change_pct"))


@query(f"""WITH t AS (SELECT ticker, day, row_number() OVER (PARTITION BY ticker ORDER BY day, close) AS rn, greatest(1, count(*) OVER (PARTITION BY ticker) // 5) AS step FROM {DAILY})
SELECT ticker, strftime(day, '%Y-%m-%d') AS day FROM t WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 5""")
def w3_systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return series.systematic_sample(_prices(spark, d), 5).select("ticker", F.date_format("Date", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) WHERE (rn - 1) % 10 = 0")
def w4_every_nth(spark: SparkSession, d: str) -> DataFrame:
    return series.every_nth(table(spark, d, "events").select("event_id"), 10, "event_id")


@query(f"SELECT ticker, strftime(day, '%Y-%m-%d') AS day, rn::BIGINT AS from_end FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC, close DESC) AS rn FROM {DAILY}) WHERE rn <= 3")
def w5_tail(spark: SparkSession, d: str) -> DataFrame:
    return series.tail(_prices(spark, d), 3).select("ticker", F.date_format("Date", "yyyy-MM-dd").alias("day"), F.col("from_end").cast("long").alias("from_end"))


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 64)::BIGINT AS chunk FROM events")
def w13_chunks(spark: SparkSession, d: str) -> DataFrame:
    return series.chunks(table(spark, d, "events").select("event_id"), 64, "event_id").select("event_id", F.col("chunk").cast("long").alias("chunk"))


@query("""SELECT user_id, n::BIGINT AS n, strftime(lo, '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT user_id, count(*) AS n, min(ts) AS lo FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s)""")
def x3_sessions(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.streaming.sessions import sessions

    return sessions(table(spark, d, "events"), "user_id", "ts").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("SELECT n_nationkey, coalesce(CASE WHEN length(n_name) > 6 THEN 'Firm ' || n_nationkey END, n_name) AS company FROM nation")
def j4_default_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    names = n.where("length(n_name) > 6").select("n_nationkey", F.concat(F.lit("Firm "), "n_nationkey").alias("name"))  # the lookup table lacks the others
    return series.looked_up(n, names.unionByName(names), "n_nationkey", "n_name", "company").select("n_nationkey", "company")


@query("SELECT request_id, coalesce(lang, 'auto') AS lang, coalesce(is_mixed, false) AS is_mixed FROM chat_requests")
def f21_back_fill(spark: SparkSession, d: str) -> DataFrame:
    return profiles.back_fill(table(spark, d, "chat_requests"), {"lang": "auto", "is_mixed": False, "no_such": 1}).select("request_id", "lang", "is_mixed")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def r8_json_access(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", numeric.json_values(F.col("props"), {"k": -1})[0])


@query("SELECT id, min(n)::BIGINT AS n FROM (SELECT id, len(map_keys(props)) - len(list_filter(map_values(props), lambda v: v IS NULL)) AS n FROM entities WHERE props IS NOT NULL) GROUP BY id")
def r9_drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").where("props is not null")
    return e.groupBy("id").agg(F.min(F.size(numeric.drop_nulls(F.col("props")))).cast("long").alias("n"))


IDS = "list_transform(embedding, lambda x: (floor(abs(x) * 20))::INT)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x) * 20).cast("int")).alias("ids"))


@query(f"SELECT vec_id, array_to_string(list_concat([2], ({IDS})[:20], [3]), ',') AS framed FROM embeddings")
def r2_frame(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("vec_id", F.array_join(numeric.frame(F.col("ids"), 20), ",").alias("framed"))


@query(f"""WITH r AS (SELECT vec_id, vec_id // 8 AS batch, ({IDS})[:(vec_id % 9 + 2)::INT] AS ids FROM embeddings), x AS (SELECT *, ids[:-2] AS dec, ids[2:] AS lab, max(len(ids)) OVER (PARTITION BY batch) AS w FROM r)
SELECT vec_id, array_to_string(list_concat(dec, list_transform(range(w - 1 - len(dec)), lambda i: 0)), ',') AS dec, array_to_string(list_concat(lab, list_transform(range(w - 1 - len(lab)), lambda i: -100)), ',') AS labels FROM x""")
def r3_padded_batches(spark: SparkSession, d: str) -> DataFrame:
    r = _ids(spark, d).select(F.floor(F.col("vec_id") / 8).alias("batch"), "vec_id", F.slice("ids", F.lit(1), (F.col("vec_id") % 9 + 2).cast("int")).alias("tgt_ids"))
    out = corpus.padded_batches(r.withColumn("src_ids", F.col("tgt_ids")), "batch", keep=("vec_id",))
    return out.select("vec_id", F.array_join("dec", ",").alias("dec"), F.array_join("labels", ",").alias("labels"))


@query(f"""SELECT vec_id, len(list_filter(range(1, len(ids) - 1), lambda i: i < len(ids) - 1 AND ids[i:i + 1] = ids[len(ids) - 1:len(ids)])) > 0 AS repeats FROM (SELECT vec_id, {IDS} AS ids FROM embeddings)""")
def r4_repeated_ngram(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("vec_id", numeric.has_repeated_ngram(F.col("ids"), 2).alias("repeats"))


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: CASE WHEN i % 5 = 0 THEN CASE WHEN embedding[i + 1] > 0 THEN embedding[i + 1]::DOUBLE / 1.2 ELSE embedding[i + 1]::DOUBLE * 1.2 END ELSE embedding[i + 1]::DOUBLE END)), 4)::DOUBLE AS total FROM embeddings")
def r5_repetition_penalty(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = numeric.repetition_penalty(v, F.array(*[F.lit(i) for i in range(0, 64, 5)]), 1.2)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"SELECT vec_id, array_to_string(list_filter({IDS}, lambda x: x NOT IN (0, 1, 2, 3)), ',') AS ids FROM embeddings")
def r6_drop_special(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("vec_id", F.array_join(numeric.drop_special(F.col("ids")), ",").alias("ids"))


@query("""SELECT id, greatest(coalesce(a::DOUBLE, 0), coalesce(b::DOUBLE, 0))::DOUBLE AS confidence, coalesce(x, y) AS role FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '0.5' END AS a, '0.25' AS b, CASE WHEN s_suppkey % 3 = 0 THEN 'old' END AS x, 'new' AS y FROM supplier)""")
def r1_merge_attributes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    a = F.create_map(F.lit("confidence"), F.when(k % 2 == 0, "0.5"), F.lit("role"), F.when(k % 3 == 0, "old"))
    m = numeric.merge_attributes(a, F.create_map(F.lit("confidence"), F.lit("0.25"), F.lit("role"), F.lit("new")))
    return table(spark, d, "supplier").select(k.alias("id"), m["confidence"].cast("double").alias("confidence"), m["role"].alias("role"))


@query("SELECT p_partkey, p_brand || ' had a closing price of ₹' || p_size || ' on 2024-01-01 according to historical records.' AS sentence FROM part")
def s4_history_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", readers.history_sentence(F.col("p_brand"), F.col("p_size").cast("string"), F.lit("2024-01-01")).alias("sentence"))


@query("""WITH b AS (SELECT vec_id AS parent, unnest(embedding)::DOUBLE AS lp, unnest(range(64)) AS token FROM embeddings), s AS (SELECT parent, token, round(lp - (parent % 7) / 10.0, 6)::DOUBLE AS score FROM b)
SELECT parent::BIGINT AS parent, token::BIGINT AS token, score FROM s ORDER BY score DESC, parent * 64 + token LIMIT 50""")
def r7_beam_step(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best continuations of as many beams as there are vectors, which are their log-probabilities."""
    v = table(spark, d, "embeddings")
    beams = v.select(F.col("vec_id").alias("beam"), (-(F.col("vec_id") % 7) / 10.0).alias("score"), F.transform("embedding", lambda x: x.cast("double")).alias("logp"))
    return corpus.beam_step(beams, 50, 64).select(F.col("parent").cast("long").alias("parent"), F.col("token").cast("long").alias("token"), F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN published_at WHEN 1 THEN date_trunc('day', published_at) WHEN 2 THEN date_trunc('month', published_at) END AS d FROM documents) WHERE d BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2024-06-30'")
def f5_text_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates as text in several forms, some unreadable."""
    at, k = F.col("published_at"), F.col("doc_id") % 4
    said = F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(k == 1, F.date_format(at, "dd-MM-yyyy")).when(k == 2, F.date_format(at, "yyyy-MM")).otherwise(F.lit("unknown"))
    rows = series.between_dates(table(spark, d, "documents").select("doc_id", said.alias("said")), "said", "2023-01-01", "2024-06-30")
    return rows.select("doc_id")
