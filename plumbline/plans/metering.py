"""Usage, budget, limiter and cache queries, in batch and as streams."""

from pyspark.sql import functions as F

from plumbline import refdata as R
from plumbline.operators import metering as op
from plumbline.plans.oracle import CTES
from plumbline.plans.registry import query, steady, steady_sql
from plumbline.streaming import metering as stream

c = F.col
U = ("api_usage", "costed")


def _price(slot: int) -> str:
    arms = " ".join(f"WHEN '{m}' THEN {p[slot]}::DOUBLE" for m, p in R.PRICES.items())
    return f"(CASE model {arms} ELSE 0.0::DOUBLE END)"


CTES["costed"] = f"""
  SELECT event_id, endpoint, model, created_at, output_tokens, input_tokens+coalesce(cache_read,0)+coalesce(cache_write,0) AS input_tokens,
    0.0::DOUBLE + input_tokens/1000000.0::DOUBLE*{_price(0)} + output_tokens/1000000.0::DOUBLE*{_price(1)}
    + coalesce(cache_read,0)/1000000.0::DOUBLE*{_price(2)} + coalesce(cache_write,0)/1000000.0::DOUBLE*{_price(3)} AS estimated_cost
  FROM api_usage"""


def costed(t):
    return op.with_cost(t.api_usage)


@query("usage_cost", U, "SELECT event_id, input_tokens, round(estimated_cost, 9) AS estimated_cost FROM costed")
def _cost(t):
    return costed(t).select("event_id", "input_tokens", F.round("estimated_cost", 9).alias("estimated_cost"))


@query("endpoint_usage", U, f"""
SELECT CAST(created_at::DATE AS VARCHAR) AS day, endpoint, {steady_sql('sum(estimated_cost)*1000')} AS cost_milli, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS calls FROM costed GROUP BY 1, 2""")
def _endpoints(t):
    return op.endpoint_usage(costed(t)).select("day", "endpoint", steady(c("cost") * 1000).alias("cost_milli"),
                                               "input_tokens", "output_tokens", "calls")


@query("daily_spend", U, f"""
SELECT CAST(created_at::DATE AS VARCHAR) AS day, {steady_sql('sum(estimated_cost)*1000')} AS spend_milli, sum(estimated_cost) >= 0.5 AS exceeded,
  sum(estimated_cost)/0.5 >= 0.8 AS warning FROM costed GROUP BY 1""")
def _daily(t):
    return op.daily_spend(costed(t), ceiling=0.5).select("day", steady(c("spend") * 1000).alias("spend_milli"),
                                                         "exceeded", "warning")


@query("budget_events", U, """
WITH run AS (SELECT event_id, created_at, epoch_us(created_at) // 86400000000 AS day, sum(estimated_cost) OVER (PARTITION BY created_at::DATE
  ORDER BY created_at, event_id) AS spend FROM costed)
SELECT day, 'warn' AS level, arg_min(event_id, created_at) AS event_id FROM run WHERE spend >= 0.3*0.8 GROUP BY 1
UNION ALL SELECT day, 'stop', arg_min(event_id, created_at) FROM run WHERE spend >= 0.3 GROUP BY 1""")
def _budget(t):
    return op.budget_events(costed(t), ceiling=0.3)


def limiter_sql(window: int, limit: int, source: str) -> str:
    return f"""
starts AS (SELECT key, min(at_us) AS at FROM {source} GROUP BY key
  UNION ALL SELECT s.key, (SELECT min(r.at_us) FROM {source} r WHERE r.key=s.key AND r.at_us >= s.at+{window}) FROM starts s WHERE s.at IS NOT NULL),
ranked AS (SELECT r.event_id, r.key, s.at AS start, row_number() OVER (PARTITION BY r.key, s.at ORDER BY r.at_us, r.event_id) AS position
  FROM {source} r JOIN starts s ON s.key=r.key AND r.at_us >= s.at AND r.at_us < s.at+{window})
SELECT event_id, key, position, position <= {limit} AS allowed FROM ranked"""


@query("rate_limit", ("requests",), "WITH " + limiter_sql(86_400_000_000, 3, "requests").strip(), recursive=True)
def _limit(t):
    return op.rate_limit(t.requests, 3, 86_400).select("event_id", "key", c("position").cast("bigint").alias("position"), "allowed")


@query("limiter_names", ("requests",), """
SELECT event_id, 'You''ve reached the limit for "' || CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'AI takeoff on this page' WHEN 1 THEN 'AI calls per minute' ELSE key END
  || '" (5 per window). Please wait and try again.' AS reason FROM requests""")
def _names(t):
    key = F.when(c("event_id") % 3 == 0, F.concat(F.lit("takeoff:"), c("key"))).when(
        c("event_id") % 3 == 1, "global:per-minute").otherwise(c("key"))
    return t.requests.select("event_id", op.denial_reason(key, 5).alias("reason"))


@query("cache_keys", (), """
SELECT doc_id, sha256('specs' || chr(0) || lang || chr(0) || text) AS plain,
  sha256('specs' || chr(0) || lang || chr(0) || text || chr(0) || sha256(text)) AS hashed FROM documents""")
def _keys(t):
    return t.raw("documents").select(
        "doc_id", op.cache_key(F.lit("specs"), c("lang"), c("text")).alias("plain"),
        op.cache_key(F.lit("specs"), c("lang"), c("text"), F.sha2("text", 256)).alias("hashed"))


@query("cache_lookup", (), """
WITH newest AS (SELECT user_id % 40 AS k, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events WHERE event_id % 2 = 0 AND user_id % 40 <> 7 GROUP BY 1)
SELECT e.event_id, CASE WHEN epoch_us(n.ts)+86400000000*10 > epoch_us(e.ts)+86400000000*9 THEN n.event_id END AS response,
  coalesce(epoch_us(n.ts)+86400000000*10 > epoch_us(e.ts)+86400000000*9, false) AS hit FROM events e LEFT JOIN newest n ON n.k=e.user_id % 40""")
def _lookup(t):
    ev = t.raw("events").select("event_id", (c("user_id") % 40).alias("cache_key"),
                                F.unix_micros(c("ts").cast("timestamp")).alias("at"))
    entries = ev.where((c("event_id") % 2 == 0) & (c("cache_key") != 7)).select(
        "cache_key", c("event_id").alias("response"), c("at").alias("created_at"), (c("at") + op.DAY * 10).alias("expires_at"))
    return op.cache_lookup(ev.withColumn("at", c("at") + op.DAY * 9), entries).select("event_id", "response", "hit")


@query("cache_accounting", ("requests",), "WITH " + limiter_sql(3_600_000_000 * 12, 1, "requests").strip().replace(
    "position <= 1 AS allowed", "position = 1 AS billed").replace("key, position, ", "key, "), recursive=True)
def _accounting(t):
    return op.cache_accounting(t.requests, 12 * 3600).select("event_id", "key", "billed")


@query("file_hash_texts", (), "SELECT page_id, sha256(html) AS digest FROM pages")
def _hash(t):
    return t.raw("pages").select("page_id", F.sha2("html", 256).alias("digest"))


# --- streams -----------------------------------------------------------------------------------
@query("daily_usage_stream", U, f"""
SELECT CAST(created_at::DATE AS VARCHAR) AS day, endpoint, {steady_sql('sum(estimated_cost)*1000')} AS cost_milli, count(*) AS calls FROM (
SELECT created_at, endpoint, input_tokens/1000000.0::DOUBLE*{_price(0)} + output_tokens/1000000.0::DOUBLE*{_price(1)} AS estimated_cost FROM api_usage) GROUP BY 1, 2""")
def _usage_stream(t):
    raw = stream.usage_stream(t.spark, f"{t.folder}/events*.parquet")
    model = F.when(c("user_id") % 3 == 0, "claude-sonnet-4-5").when(c("user_id") % 3 == 1, "claude-haiku-4-5").otherwise("house-model")
    calls = raw.select(c("event_type").alias("endpoint"), model.alias("model"), F.floor(c("value") * 100).alias("input_tokens"),
                       F.floor(c("value") * 10).alias("output_tokens"), "created_at")
    out = stream.run_to_files(stream.daily_usage_stream(stream.with_stream_cost(calls)), "complete")
    return out.select("day", "endpoint", steady(c("cost") * 1000).alias("cost_milli"), "calls")


@query("rate_limit_stream", ("requests",), ("WITH " + limiter_sql(86_400_000_000, 3, "requests").strip()).replace("position, position <=", "position <="), recursive=True)
def _limit_stream(t):
    raw = stream.usage_stream(t.spark, f"{t.folder}/events*.parquet")
    calls = raw.select(c("user_id").cast("string").alias("key"), "event_id", c("created_at").alias("at"))
    return stream.run_to_files(stream.limiter_stream(calls, 3, 86_400))


@query("cache_lookup_stream", ("requests",), """
SELECT r.key, r.event_id, CASE WHEN p.at_us + 3600000000 * (1 + p.event_id % 48) > r.at_us THEN 'answer ' || p.event_id END AS response,
  coalesce(p.at_us + 3600000000 * (1 + p.event_id % 48) > r.at_us, false) AS hit
FROM (SELECT * FROM requests WHERE event_id % 3 <> 0) r LEFT JOIN (SELECT * FROM requests WHERE event_id % 3 = 0) p ON p.key = r.key AND p.at_us <= r.at_us
QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY p.at_us DESC, p.event_id DESC) = 1""")
def _cache_stream(t):
    """Every third event puts a response that lives for one to two days; the others ask for one."""
    raw = stream.usage_stream(t.spark, f"{t.folder}/events*.parquet")
    put = c("event_id") % 3 == 0
    events = raw.select(c("user_id").cast("string").alias("key"), "event_id", c("created_at").alias("at"), (~put).alias("is_request"),
                        F.when(put, F.concat(F.lit("answer "), c("event_id").cast("string"))).alias("response"),
                        F.when(put, (c("event_id") % 48 + 1) * 3600).otherwise(0).alias("ttl_seconds"))
    return stream.run_to_files(stream.cache_lookup_stream(events))
