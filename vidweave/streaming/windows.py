"""Rate, lockout, progress, outbox, state and cache operators: batch forms over event tables, and their streams.

Counting forms are windows and aggregates. Anchored windows and guarded state folds are sequential in each key, yet no
key's events meet in one task: anchors are found by doubling pointers, folds by composing maps of runs of events
(operators.scans). As a stream the lockout is an arbitrary stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidweave.operators.scans import Scan, chain, ordered_fold, prefix_scan
from vidweave.operators.search_index import update_index
from vidweave.sources.storage import stored


def rate_limit(requests: DataFrame, limit: int, seconds: int, scope: str = "scope", ts: str = "ts", order: str = "request_id") -> DataFrame:
    """Fixed buckets of the clock: in each scope and bucket the first `limit` requests are allowed. The hot scope's
    buckets are separate groups, so it does not land in one task."""
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    n = F.row_number().over(Window.partitionBy(scope, "bucket").orderBy(ts, order)).cast("long")
    return requests.withColumn("bucket", bucket).withColumn("n", n).withColumn("allowed", F.col("n") <= limit)


def rate_limit_stream(requests: DataFrame, limit: int, seconds: int, scope: str = "scope", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Scopes over the limit in each tumbling window, once the watermark has passed it; later rows are dropped."""
    w = requests.withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), scope).agg(F.count(F.lit(1)).alias("n"))
    return w.where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), scope, "n")


LOCKOUT = "attempt_id long, key string, failures long, captcha boolean, blocked boolean, retry_after_s long"


def lockout_step(key, state: tuple, ts: int, attempt: int, success: bool, window_s: int = 600, captcha: int = 3, most: int = 5) -> tuple[tuple, tuple]:
    """The next state (anchor or None, failures) of a key and the verdict of an attempt. The window is anchored at
    its first failure; blocked attempts are not counted; success clears."""
    anchor, failures = state
    if anchor is not None and ts > anchor + window_s:
        anchor, failures = None, 0
    if failures >= most:
        return (anchor, failures), (attempt, key, failures, True, True, int(anchor + window_s - ts))
    anchor, failures = (None, 0) if success else (ts if anchor is None else anchor, failures + 1)
    return (anchor, failures), (attempt, key, failures, failures >= captcha, False, 0)


def lockout_rows(key: str, rows: list[tuple], **limits: int) -> list[tuple]:
    """Verdicts of one key's attempts (ts in seconds, attempt_id, success), in order."""
    state, out = (None, 0), []
    for ts, attempt, success in rows:
        state, made = lockout_step(key, state, ts, attempt, success, **limits)
        out.append(made)
    return out


def _places(events: DataFrame, key: str, ts: str, order: str, window_s: int, width_s: int, counts: dict[str, Column]) -> DataFrame:
    """events with, for each of counts (conditions), how many such rows of the key come before them (`name`), and how
    many come no later than window_s after them (`name_in`)."""
    marks = [F.when(c, 1).otherwise(0).alias(n) for n, c in counts.items()]
    real = events.select("*", *marks, F.col(ts).alias("_t"), F.lit(0).alias("_kind"))
    probes = events.select("*", *[F.lit(0).alias(n) for n in counts], (F.col(ts) + window_s).alias("_t"), F.lit(1).alias("_kind"))
    scans = [Scan(f"{n}_before", "sum", F.col(n)) for n in counts]
    both = prefix_scan(real.unionByName(probes), key, F.col("_t"), width_s, ["_t", "_kind", order], scans)
    zero = lambda n: F.coalesce(F.col(f"{n}_before"), F.lit(0)).cast("long")
    within = both.where("_kind = 1").select(F.struct(F.col(key)).alias("_k"), F.col(order).alias("_o"), *[zero(n).alias(f"{n}_in") for n in counts])
    here = both.where("_kind = 0").select(*events.columns, *[zero(n).alias(n) for n in counts])
    return here.join(within, (F.struct(F.col(key)) == F.col("_k")) & (F.col(order) == F.col("_o"))).drop("_k", "_o")


def login_lockout(attempts: DataFrame, window_s: int = 600, captcha: int = 3, most: int = 5, width_s: int = 86_400) -> DataFrame:
    """attempts (key, ts_s, attempt_id, success) with the verdict of each.

    A failure that finds no open window anchors one. It is closed by a success before `most` failures, or by its end;
    the next anchor is the first failure after that. So each failure points to the failure that would be the next
    anchor, and the anchors are the chain of these pointers from the first failure on. Counts come from prefix scans
    over ranges of `width_s` seconds, so that a hot key is dealt over many tasks. attempt_id is unique."""
    a = attempts.select("key", "ts_s", "attempt_id", "success")
    placed = stored(_places(a, "key", "ts_s", "attempt_id", window_s, width_s, {"failed": ~F.col("success")}), "lockout-places")
    end = F.when(F.col("success"), F.struct("ts_s", "attempt_id", "failed"))
    ahead = prefix_scan(placed, "key", F.col("ts_s"), width_s, ["ts_s", "attempt_id"], [Scan("cleared", "last", end, reverse=True)])
    closed = (F.col("cleared.ts_s") <= F.col("ts_s") + window_s) & (F.col("cleared.failed") - F.col("failed") < most)
    opened = stored(ahead.where("NOT success").withColumn("cleared", F.when(closed, F.col("cleared"))), "lockout-failures")
    pointers = opened.select("key", F.col("failed").alias("at"), F.coalesce("cleared.failed", "failed_in").alias("to"))
    anchors = chain(pointers, "key").withColumnRenamed("key", "_k").withColumnRenamed("at", "_f")
    row = F.struct("ts_s", "failed", "cleared").alias("anchor")
    anchors = opened.join(anchors, F.col("key").eqNullSafe(F.col("_k")) & (F.col("failed") == F.col("_f"))).select(F.struct("key").alias("_k"), "attempt_id", row)
    marked = placed.withColumn("_k", F.struct("key")).join(anchors, ["_k", "attempt_id"], "left").drop("_k")
    judged = prefix_scan(marked, "key", F.col("ts_s"), width_s, ["ts_s", "attempt_id"], [Scan("open", "last", F.col("anchor"), inclusive=True)])
    since = F.col("failed") - F.col("open.failed")
    after = F.struct("ts_s", "attempt_id") > F.struct("open.cleared.ts_s", "open.cleared.attempt_id")
    none = F.col("open").isNull() | (F.col("ts_s") > F.col("open.ts_s") + window_s) | F.coalesce(F.col("open.cleared").isNotNull() & after, F.lit(False))
    blocked = ~none & (since >= most)
    failures = F.when(none, 0).when(blocked, most).when(F.col("success"), 0).otherwise(since + 1).cast("long")
    retry = F.when(blocked, F.col("open.ts_s") + window_s - F.col("ts_s")).otherwise(0).cast("long")
    return judged.select("attempt_id", "key", failures.alias("failures"), (failures >= captcha).alias("captcha"), blocked.alias("blocked"), retry.alias("retry_after_s"))


def login_lockout_stream(attempts: DataFrame, window_s: int = 600, captcha: int = 3, most: int = 5, delay: str = "10 minutes") -> DataFrame:
    """The same as a stateful stream in event time: the state of a key is its anchor and failures, and goes once the
    watermark has passed the anchored window, so a replay of old events is judged as they were. Events of a key that
    come in one micro-batch are sorted together; later than `delay`, they are dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, failures = state.get if state.exists else (-1, 0)
        now, out = (None if failures == 0 else anchor, failures), []
        for r in pd.concat(list(batches)).sort_values(["ts_s", "attempt_id"]).itertuples(index=False):
            now, made = lockout_step(key[0], now, r.ts_s, r.attempt_id, r.success, window_s, captcha, most)
            out.append(made)
        if now[0] is None:
            state.remove()
        else:
            state.update((int(now[0]), int(now[1])))
            state.setTimeoutTimestamp(max((int(now[0]) + window_s + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in LOCKOUT.split(", ")])

    timed = attempts.withColumn("_ts", F.timestamp_seconds("ts_s")).withWatermark("_ts", delay)
    return timed.groupBy("key").applyInPandasWithState(run, LOCKOUT, "anchor long, failures long", "append", "EventTimeTimeout")


def progress(events: DataFrame, key: str, ts: str, as_of: Column, ttl: str = "30 minutes") -> DataFrame:
    """The newest snapshot of each key that is not older than the time to live. Works on a stream in update mode."""
    cols = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(ts, *[c for c in cols if c.endswith("_id")])).alias("l"))
    return last.select(key, "l.*").where(F.col(ts) >= as_of - F.expr(f"INTERVAL {ttl}"))


def outbox_create(commands: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first command of each key; repeats change nothing."""
    return commands.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in commands.columns if c not in keys]), F.struct(*order)).alias("e")).select(*keys, "e.*")


def outbox_create_stream(commands: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    return commands.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


#: What each change needs and makes.
EVENT_MOVES: dict[str, tuple[tuple[str, ...], str]] = {
    "publish": (("PENDING", "PUBLISH_FAILED"), "PUBLISHED"),
    "publish_failed": (("PENDING", "PUBLISH_FAILED"), "PUBLISH_FAILED"),
    "claim": (("PENDING", "PUBLISH_FAILED", "PUBLISHED", "CONSUME_FAILED"), "CONSUMING"),
    "recover": (("CONSUMING",), "PUBLISHED"),
    "consumed": (("CONSUMING",), "CONSUMED"),
    "retry": (("DLQ", "CONSUME_FAILED", "PUBLISH_FAILED"), "PENDING"),
}


def event_move(change: str, state: tuple[str, int], most_attempts: int) -> tuple[str, int] | None:
    """The state (status, attempts) after a change, or None where its guard does not hold."""
    status, attempts = state
    if change == "failed" and status == "CONSUMING":
        return ("DLQ" if attempts + 1 >= most_attempts else "CONSUME_FAILED"), attempts + 1
    if change in EVENT_MOVES and status in EVENT_MOVES[change][0]:
        return EVENT_MOVES[change][1], 0 if change == "retry" else attempts
    return None


def event_states(most_attempts: int) -> list[tuple[str, int]]:
    """All states that changes lead to, the starting one first."""
    states = [("PENDING", 0)]
    for state in states:  # grows
        for change in (*EVENT_MOVES, "failed"):
            after = event_move(change, state, most_attempts)
            if after is not None and after not in states:
                states.append(after)
    return states


def event_state_fold(changes: DataFrame, key: str, order: list[str], most_attempts: int = 3) -> DataFrame:
    """The status and attempts of each key after its changes (column change) in order; a change whose guard does not
    hold is passed over, as is an unknown one. `failed` leads to CONSUME_FAILED, or DLQ at the last attempt; `retry`
    starts anew.

    A change is a map of states to states, with a count of changes applied; maps compose, so runs of a key's changes
    are folded apart from each other and a hot key is dealt over many tasks. A map is an array: for each state it
    starts from, base times the changes applied, plus the code of the state it ends in."""
    states, names = event_states(most_attempts), (*EVENT_MOVES, "failed")
    base = len(states)
    code = lambda after, s: s if after is None else base + states.index(after)
    moves = [[code(event_move(c, state, most_attempts), s) - s for s, state in enumerate(states)] for c in names]
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in (*moves, [0] * base)])
    numbers = F.create_map(*[x for k, c in enumerate(names) for x in (F.lit(c), F.lit(k))])
    coded = changes.withColumn("_code", F.coalesce(F.try_element_at(numbers, F.col("change")), F.lit(len(names))))
    identity = F.array(*[F.lit(s).cast("long") for s in range(base)])
    end = lambda v: (v % base).cast("int")
    run = lambda items: F.aggregate(items, identity, lambda f, x: F.transform(f, lambda v: v + F.get(F.get(table, x["_code"]), end(v))))
    folded = ordered_fold(coded, key, order, run, ["_code"], lambda f, g: F.transform(f, lambda v: v - v % base + F.get(g, end(v))))
    last = F.get("folded", 0)
    of = lambda xs: F.get(F.array(*map(F.lit, xs)), end(last))
    return folded.select(key, of([s for s, _ in states]).alias("status"), of([n for _, n in states]).cast("long").alias("attempts"), F.floor(last / base).alias("applied"))


def job_state_fold(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Compare-and-set by version: a change (version, status) applies if its version is the current one, from 0 on.

    A run of changes is a map of versions: those that it names and moves, each with the version and status it ends at;
    others stay. Maps compose, so runs are folded apart. A key's map holds an entry for each version that its changes
    name."""
    to = lambda v, status: F.struct(v.alias("version"), status.alias("status"))
    none = F.map_filter(F.create_map(F.lit(0).cast("long"), to(F.lit(0).cast("long"), F.lit(""))), lambda k, _: k != 0)

    def one(f: Column, x: Column) -> Column:
        moved = F.transform_values(f, lambda _, s: F.when(s["version"] == x["version"], to(x["version"] + 1, x["status"])).otherwise(s))
        fresh = F.create_map(x["version"], to(x["version"] + 1, x["status"]))
        return F.when(x["version"].isNull(), f).when(F.map_contains_key(f, x["version"]), moved).otherwise(F.map_concat(moved, fresh))

    def both(f: Column, g: Column) -> Column:
        moved = F.transform_values(f, lambda _, s: F.coalesce(F.try_element_at(g, s["version"]), s))
        return F.map_concat(moved, F.map_filter(g, lambda v, _: ~F.map_contains_key(f, v)))

    c = changes.withColumn("version", F.col("version").cast("long"))
    folded = ordered_fold(c, key, order, lambda items: F.aggregate(items, none, one), ["version", "status"], both)
    end = F.try_element_at("folded", F.lit(0).cast("long"))
    status = F.coalesce(end["status"], F.lit("PENDING"))
    return folded.select(key, status.alias("status"), F.coalesce(end["version"], F.lit(0).cast("long")).alias("version"), status.isin("DONE", "FAILED").alias("finished"))


def last_question_memory(asks: DataFrame, key: str, ts: str, order: str, ttl: str = "20 minutes") -> DataFrame:
    """The question before each ask of its key, if it is not older than the time to live."""
    prev = F.lag(F.struct("question", ts)).over(Window.partitionBy(key).orderBy(ts, order))
    fresh = F.col(ts) <= F.col(f"_p.{ts}") + F.expr(f"INTERVAL {ttl}")
    return asks.withColumn("_p", prev).withColumn("previous", F.when(fresh, F.col("_p.question"))).drop("_p")


def cache_hits(asks: DataFrame, scope: str, question: str, ts: str, order: str) -> DataFrame:
    """Every repeat of a question in its scope is a hit."""
    key = F.md5(F.lower(F.trim(question)))
    n = F.row_number().over(Window.partitionBy(scope, "cache_key").orderBy(ts, order))
    return asks.withColumn("cache_key", key).withColumn("hit", n > 1)


def cache_hits_ttl(asks: DataFrame, ttl_s: int = 1800, width_s: int = 86_400) -> DataFrame:
    """asks (key, ts_s, ask_id): a hit if the stored answer is not older than ttl_s; its time starts at the miss. The
    misses are the chain of pointers from each ask to the first one beyond its time to live."""
    a = asks.select("key", "ts_s", "ask_id")
    placed = stored(_places(a, "key", "ts_s", "ask_id", ttl_s, width_s, {"asked": F.lit(True)}), "cache-places")
    misses = chain(placed.select("key", F.col("asked").alias("at"), F.col("asked_in").alias("to")), "key")
    marked = misses.select(F.struct("key").alias("_k"), F.col("at").alias("asked"), F.lit(True).alias("_miss"))
    return placed.withColumn("_k", F.struct("key")).join(marked, ["_k", "asked"], "left").select("ask_id", "key", F.col("_miss").isNull().alias("hit"))


def ingest_stream(segments: DataFrame, index_path: str, checkpoint: str, build) -> object:
    """Each micro-batch of segments (streaming) through build(batch) and appended under its batch id, so that a batch
    that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{index_path}/batch={batch_id}")

    return segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(segments: DataFrame, path: str, checkpoint: str, **options) -> object:
    """Each micro-batch of segments (streaming) put into the search index at path: its segments replace those of their
    ids, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), F.struct("start_ms", "content")).alias("l")).select("id", "l.*")
        update_index(last, path, **options)

    return segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
