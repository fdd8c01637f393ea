"""Queries of the rate, state and cache operators over the event tables (batch form), with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.operators import search_index
from vidweave.sources import tables as S
from vidweave.sources.storage import new_path
from vidweave.sources.tables import table, with_ctes
from vidweave.streaming import windows as W

from .text_queries import _TOK


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def h1_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    r = _events(spark, d).select(F.col("user_id").cast("long").alias("scope"), "ts", F.col("event_id").cast("long").alias("request_id"))
    return W.rate_limit(r, 2, 86400).select("request_id", "scope", "n", "allowed")


H1 = """SELECT request_id, scope, n, n <= 2 AS allowed FROM (SELECT CAST(event_id AS BIGINT) AS request_id, CAST(user_id AS BIGINT) AS scope, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS n FROM events)"""


def h2_login_lockout(spark: SparkSession, d: str) -> DataFrame:
    a = _events(spark, d).where("event_type IN ('error', 'signup')").select(F.col("user_id").cast("string").alias("key"), F.unix_timestamp("ts").alias("ts_s"), F.col("event_id").cast("long").alias("attempt_id"), (F.col("event_type") == "signup").alias("success"))
    return W.login_lockout(a, window_s=864000, captcha=2, most=3, width_s=7 * 86400)


def _fold(rows: str, start: str, step: str, done: str) -> str:
    """SQL that folds rows (key, n from 1, fields) key by key: start and step give the state's columns from the row c
    and the state f; done selects from the last states."""
    return f"""WITH RECURSIVE c AS ({rows}), f AS (SELECT c.*, {start} FROM c WHERE n = 1 UNION ALL SELECT c.*, {step} FROM f JOIN c ON c.key = f.key AND c.n = f.n + 1) {done}"""


def _lockout(window: int, captcha: int, most: int) -> str:
    """The steps of the lockout as SQL; a, k: anchor and failures that the attempt meets."""
    a, k = f"(CASE WHEN c.ts_s > f.anchor + {window} THEN NULL ELSE f.anchor END)", f"(CASE WHEN c.ts_s > f.anchor + {window} THEN 0 ELSE f.failures END)"
    anchor = f"CASE WHEN {k} >= {most} THEN {a} WHEN c.success THEN NULL ELSE coalesce({a}, c.ts_s) END AS anchor"
    failures = f"CASE WHEN {k} >= {most} THEN {k} WHEN c.success THEN 0 ELSE {k} + 1 END AS failures"
    return f"{anchor}, {failures}, {k} >= {most} AS blocked, CASE WHEN {k} >= {most} THEN {a} + {window} - c.ts_s ELSE 0 END AS retry"


H2 = _fold(
    "SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CAST(event_id AS BIGINT) AS attempt_id, event_type = 'signup' AS success, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events WHERE event_type IN ('error', 'signup')",
    "CASE WHEN success THEN NULL ELSE ts_s END AS anchor, CASE WHEN success THEN 0 ELSE 1 END AS failures, false AS blocked, CAST(0 AS BIGINT) AS retry",
    _lockout(864000, 2, 3), "SELECT attempt_id, key, CAST(failures AS BIGINT) AS failures, blocked OR failures >= 2 AS captcha, blocked, CAST(retry AS BIGINT) AS retry_after_s FROM f",
)


def h3_progress_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "ts", F.col("event_id").cast("long").alias("event_id"), "event_type")
    return W.progress(e, "user_id", "ts", F.lit("2024-01-28 00:00:00").cast("timestamp"), "100 hours").select("user_id", "event_id", "event_type")


H3 = "SELECT user_id, event_id, event_type FROM (SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ts >= TIMESTAMP '2024-01-28' - INTERVAL 100 HOUR"


def h4_outbox_create(spark: SparkSession, d: str) -> DataFrame:
    c = _events(spark, d).select(F.col("user_id").cast("long").alias("job_id"), "event_type", "ts", F.col("event_id").cast("long").alias("event_id"))
    return W.outbox_create(c, ["job_id", "event_type"], ["ts", "event_id"]).select("job_id", "event_type", "event_id")


H4 = "SELECT CAST(user_id AS BIGINT) AS job_id, event_type, CAST(arg_min(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM events GROUP BY ALL"


def h5_event_state_fold(spark: SparkSession, d: str) -> DataFrame:
    names = ["publish", "claim", "failed", "consumed", "retry", "recover", "publish_failed"]
    change = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    c = _events(spark, d).select(F.col("user_id").cast("long").alias("key"), "ts", F.col("event_id").cast("long").alias("event_id"), change.alias("change"))
    return W.event_state_fold(c, "key", ["ts", "event_id"])


def _event_moves() -> str:
    """The state after change c on state f, as SQL."""
    moves = "".join(f" WHEN c.change = '{name}' AND f.status IN ({', '.join(map(repr, needs))}) THEN '{makes}'" for name, (needs, makes) in W.EVENT_MOVES.items())
    new = f"(CASE WHEN c.change = 'failed' AND f.status = 'CONSUMING' THEN CASE WHEN f.attempts + 1 >= 3 THEN 'DLQ' ELSE 'CONSUME_FAILED' END{moves} END)"
    return f"coalesce({new}, f.status) AS status, CASE WHEN {new} IS NULL THEN f.attempts WHEN c.change = 'failed' THEN f.attempts + 1 WHEN c.change = 'retry' THEN 0 ELSE f.attempts END AS attempts, f.applied + CAST({new} IS NOT NULL AS BIGINT) AS applied"


# a row before each key's first change holds the starting state
H5 = _fold(
    """SELECT DISTINCT CAST(user_id AS BIGINT) AS key, CAST(1 AS BIGINT) AS n, '' AS change FROM events UNION ALL
SELECT CAST(user_id AS BIGINT), 1 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), ['publish', 'claim', 'failed', 'consumed', 'retry', 'recover', 'publish_failed'][event_id % 7 + 1] FROM events""",
    "'PENDING' AS status, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS applied", _event_moves(),
    "SELECT key, arg_max(status, n) AS status, CAST(arg_max(attempts, n) AS BIGINT) AS attempts, CAST(arg_max(applied, n) AS BIGINT) AS applied FROM f GROUP BY key",
)


def h6_job_state_fold(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "RUNNING").when(F.col("event_id") % 3 == 1, "DONE").otherwise("FAILED")
    c = _events(spark, d).select(F.col("user_id").cast("long").alias("key"), "ts", F.col("event_id").cast("long").alias("event_id"), (F.col("event_id") % 4).alias("version"), status.alias("status"))
    return W.job_state_fold(c, "key", ["ts", "event_id"])


H6 = _fold(
    """SELECT DISTINCT CAST(user_id AS BIGINT) AS key, CAST(1 AS BIGINT) AS n, -1 AS given, '' AS wanted FROM events UNION ALL
SELECT CAST(user_id AS BIGINT), 1 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), event_id % 4, ['RUNNING', 'DONE', 'FAILED'][event_id % 3 + 1] FROM events""",
    "'PENDING' AS status, CAST(0 AS BIGINT) AS version", "CASE WHEN c.given = f.version THEN c.wanted ELSE f.status END AS status, f.version + CAST(c.given = f.version AS BIGINT) AS version",
    "SELECT key, arg_max(status, n) AS status, CAST(arg_max(version, n) AS BIGINT) AS version, arg_max(status, n) IN ('DONE', 'FAILED') AS finished FROM f GROUP BY key",
)


def _asks(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("user_id").cast("long").alias("scope"), "ts", F.col("event_id").cast("long").alias("ask_id"), F.concat(F.col("event_type"), (F.col("event_id") % 3).cast("string")).alias("question"))


_ASKS = "WITH asks AS (SELECT CAST(user_id AS BIGINT) AS scope, ts, CAST(event_id AS BIGINT) AS ask_id, event_type || (event_id % 3) AS question FROM events) "


def h7_last_question_memory(spark: SparkSession, d: str) -> DataFrame:
    return W.last_question_memory(_asks(spark, d), "scope", "ts", "ask_id", "10 hours").select("ask_id", "scope", "previous")


H7 = _ASKS + "SELECT ask_id, scope, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 10 HOUR THEN lag(question) OVER w END AS previous FROM asks WINDOW w AS (PARTITION BY scope ORDER BY ts, ask_id)"


def h8_answer_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return W.cache_hits(_asks(spark, d), "scope", "question", "ts", "ask_id").select("ask_id", "scope", "cache_key", "hit")


H8 = _ASKS + "SELECT ask_id, scope, md5(lower(trim(question))) AS cache_key, row_number() OVER (PARTITION BY scope, question ORDER BY ts, ask_id) > 1 AS hit FROM asks"


def h8_answer_cache_hits_ttl(spark: SparkSession, d: str) -> DataFrame:
    a = _asks(spark, d).select(F.concat_ws("|", "scope", "question").alias("key"), F.unix_timestamp("ts").alias("ts_s"), "ask_id")
    return W.cache_hits_ttl(a, 5 * 86400, width_s=7 * 86400)


H8_TTL = _fold(
    "SELECT CAST(user_id AS BIGINT) || '|' || event_type || (event_id % 3) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CAST(event_id AS BIGINT) AS ask_id, row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY floor(epoch(ts)), event_id) AS n FROM events",
    "ts_s AS anchor, false AS hit", "CASE WHEN c.ts_s <= f.anchor + 432000 THEN f.anchor ELSE c.ts_s END AS anchor, c.ts_s <= f.anchor + 432000 AS hit", "SELECT ask_id, key, hit FROM f",
)


def h9_ingest(spark: SparkSession, d: str) -> DataFrame:
    """What a search index holds of each video after ingestion: built from the segments of even videos, some of them
    with an old text, then updated with the segments of the others and the new texts."""
    s, old = S.segments(spark, d), F.col("id") % 5 == 0
    path = new_path(spark, "ingested-index")
    search_index.build_index(s.where("video_id % 2 = 0").withColumn("content", F.when(old, "old text").otherwise(F.col("content"))), path, groups=[])
    return search_index.index_stats(search_index.update_index(s.where((F.col("video_id") % 2 == 1) | old), path, groups=[]))


H9 = with_ctes("segments") + f"SELECT video_id, count(*) AS indexed, CAST(sum(n) AS BIGINT) AS n_tokens FROM (SELECT video_id, len({_TOK.format('content')}) AS n FROM segments) WHERE n > 0 GROUP BY 1"

QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "h" and k[1:2].isdigit()}
ORACLES = {k: globals()[o] for k in QUERIES if (o := k.split("_")[0].upper() + ("_TTL" if k.endswith("_ttl") else "")) in globals()}
