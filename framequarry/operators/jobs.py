"""Jobs over many images: roll-ups, budgets, paging, batches, caching, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

# Batch packing, write coalescing, the rate governor, list prices, memory per megapixel.
BATCH_BYTES, BATCH_FILES = 268435456, 50
COALESCE_EVERY, COALESCE_SECONDS, RECORD_SECONDS = 10, 2.0, 86_400
GOVERNOR_START, GOVERNOR_FLOOR, GOVERNOR_TOP, GOVERNOR_RAISE, GOVERNOR_PAUSE, GOVERNOR_LONGEST = 8, 1, 8, 12, 5.0, 120.0
PRICES = {"photoroom": 0.02, "removebg": 0.20, "fal": 0.04, "gemini": 0.0065, "local": 0.0}
MB_PER_MEGAPIXEL, RESERVED_MB = 88.0, 2048


def rollup(images: DataFrame, by: str = "job") -> DataFrame:
    """Counters, cost, state and progress of each job: one partial aggregate, one shuffle of a row a job and task."""
    n = F.count(F.lit(1))
    counts = images.groupBy(by).agg(n.alias("total"), *(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("done", "failed", "skipped")), F.round(F.sum("cost"), 4).alias("cost"))
    state = F.when(F.col("done") > 0, "completed").when(F.col("skipped") > 0, "cancelled").otherwise("failed")
    return counts.withColumn("state", state).withColumn("progress_pct", progress(F.col("total"), F.col("done") + F.col("failed")))


def progress(total: Column, finished: Column) -> Column:
    """Percent with one decimal, half to even; zero for an empty job."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(100.0 * finished / total, 1))


def stopped_at(images: DataFrame, ceiling: float, ahead: float) -> DataFrame:
    """Marks images (job, seq, cost) a budget keeps from starting: spent before plus one projection over the ceiling, and all after.

    As if images ran one at a time. The running sum is by job in order; `ahead` is what the next is expected to cost.
    """
    before = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost").over(before), F.lit(0.0))
    # costs are never negative, so once over the ceiling every later image is over it too: the stop is sticky
    return images.withColumn("stopped", F.round(spent, 6) + ahead > ceiling)


def unprocessed(planned: DataFrame, recorded: DataFrame, reason: str) -> DataFrame:
    """Planned names that have no record, as skipped rows with the reason they were left."""
    return planned.join(recorded.select("job", "name"), ["job", "name"], "left_anti").select("job", "name", F.lit("skipped").alias("state"), F.lit(reason).alias("reason"))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order; the limit is kept within 1 to 200."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def batches(files: DataFrame, budget: int = BATCH_BYTES, most: int = BATCH_FILES) -> DataFrame:
    """Packs files (owner, pos, size) into upload batches in order: a batch closes before it would pass the budget or the count.

    Where a batch ends depends on where it began, so it is a fold over an owner's files in order.
    """
    budget = budget if budget > 0 else BATCH_BYTES

    def put(state: tuple, size: int) -> tuple:
        batch, held, n = state
        full = n > 0 and (held + size > budget or n >= most)
        state = (batch + 1, size, 1) if full else (batch, held + size, n + 1)
        return state, (state[0],)

    return ordered_fold(files, "owner", ("pos",), ("size",), (0, 0, 0), put, "batch int")


def governor(calls: DataFrame) -> DataFrame:
    """Limit after each call (vendor, seq, limited): halved on a refusal, one more after twelve successes in a row."""
    return governed_calls(calls.selectExpr("vendor", "seq", "limited", "0.0D as at", "cast(null as double) as retry_after")).select("vendor", "seq", "allowed")


def governed_calls(calls: DataFrame) -> DataFrame:
    """The governor's state after each call (vendor, seq, at in seconds, limited, retry_after), an ordered fold per vendor.

    allowed is the limit; resume_at the time before which no call starts, a refusal's own wait (kept within
    two minutes) or five seconds; events counts refusals. At the full limit successes do not count.
    """

    return ordered_fold(calls, "vendor", ("seq",), ("at", "limited", "retry_after"), GOVERNOR_BEGIN, governor_step, "allowed int, resume_at double, events int")


#: The governor's state: limit, successes in a row, when calls may start again, refusals.
GOVERNOR_BEGIN, GOVERNOR_STATE = (GOVERNOR_START, 0, None, 0), "allowed int, good int, resume_at double, events int"


def governor_step(state: tuple, at: float, limited: bool, wait: float | None) -> tuple[tuple, tuple]:
    limit, good, resume, events = state
    if limited:
        pause = max(0.0, min(GOVERNOR_PAUSE if wait is None else wait, GOVERNOR_LONGEST))
        state = max(GOVERNOR_FLOOR, limit // 2), 0, at + pause if resume is None else max(resume, at + pause), events + 1
    elif limit < GOVERNOR_TOP:
        good += 1
        state = (limit + 1, 0, resume, events) if good >= GOVERNOR_RAISE else (limit, good, resume, events)
    return state, (state[0], state[2], state[3])


#: A running job's state: what it has spent, whether it was asked to stop, whether its ceiling stopped it.
RUN_BEGIN, RUN_STATE = (0.0, False, False), "spent double, cancelled boolean, stopped boolean"


def run_step(ceiling: float, ahead: float):
    """Decides image by image (kind, cost) whether a job goes on; a row of kind `cancel` asks it to stop and is no image.

    An image starts only if what is spent and one projection stay within the ceiling; once over it, or asked, a job stays
    stopped. Decisions: action (run or skip) and reason.
    """

    def step(state: tuple, kind: str, cost: float | None) -> tuple[tuple, tuple | None]:
        spent, cancelled, stopped = state
        if kind == "cancel":
            return (spent, True, stopped), None
        if cancelled:
            return state, ("skip", "cancelled")
        if stopped or round(spent, 6) + ahead > ceiling:
            return (spent, cancelled, True), ("skip", "budget")
        return (spent + (cost or 0.0), cancelled, stopped), ("run", None)

    return step


def rate_limit_report(governed: DataFrame) -> DataFrame:
    """Refusals and last limit of each vendor."""
    return governed.groupBy("vendor").agg(F.max("events").alias("events"), F.max_by("allowed", "seq").alias("allowed"))


def budget_with_reservations(images: DataFrame, ceiling: float, projected: float) -> DataFrame:
    """Marks images (job, seq, started, finished, cost) that a ceiling keeps from starting while others are still running.

    Committed is what finished images cost, and the projection for each one running and for this one. Two
    rows an image, one when it starts and one when it is done, and a running sum over both; who finishes at a
    time is counted before who starts at it. Once stopped, a job stays stopped.
    """
    begun = images.select("job", "seq", F.col("started").alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("spent"), F.lit(1).alias("running"))
    done = images.select("job", "seq", F.col("finished").alias("at"), F.lit(0).alias("kind"), F.col("cost").alias("spent"), F.lit(-1).alias("running"))
    order = Window.partitionBy("job").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = begun.unionAll(done).withColumns({"committed": F.round(F.sum("spent").over(order), 6) + F.sum("running").over(order) * projected})
    over = (F.col("kind") == 1) & (F.round("committed", 6) > ceiling)
    return both.withColumn("stopped", F.max(over).over(order)).where("kind = 1").select("job", "seq", F.round("committed", 6).alias("committed"), "stopped")


def cancelled(images: DataFrame, control: DataFrame) -> DataFrame:
    """Marks images (job, started) that begin after their job was asked to stop (control: job, requested_at; one row a job at most counts, the first)."""
    first = control.groupBy("job").agg(F.min("requested_at").alias("requested_at"))
    return images.join(first, "job", "left").withColumn("cancelled", F.coalesce(F.col("started") >= F.col("requested_at"), F.lit(False))).drop("requested_at")


def flushes(changes: DataFrame) -> DataFrame:
    """Which of a job's changes (job, seq, at in seconds) writes its record: the tenth since the last write, or one two seconds after it.

    Nothing was written before the first, so it is.
    """

    def touch(state: tuple, at: float) -> tuple:
        pending, last = state
        write = pending + 1 >= COALESCE_EVERY or last is None or at - last >= COALESCE_SECONDS
        return ((0, at) if write else (pending + 1, last)), (write,)

    return ordered_fold(changes, "job", ("seq",), ("at",), (0, None), touch, "flushed boolean")


def upserted(records: DataFrame, key: str, at: str, now: Column, most_age_seconds: int = RECORD_SECONDS) -> DataFrame:
    """The last record of each key by time, if it is not older than a record is kept."""
    columns = [c for c in records.columns if c != key]
    last = records.groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("last")).select(key, "last.*")
    return last.where(F.unix_seconds(now) - F.unix_seconds(F.col(at)) <= most_age_seconds)


def cache_key(payload: Column, engine: Column, roi: Column | None = None) -> Column:
    """sha256 of the bytes, the engine, and the region if there is one."""
    parts = [F.sha2(payload, 256), engine]
    return F.concat_ws(":", *parts) if roi is None else F.concat_ws(":", *parts, roi)


def single_flight(calls: DataFrame) -> DataFrame:
    """Bills the first call of each key and lets all others hit (columns key, seq, price).

    The first is an aggregate, not a window: a key that a third of all calls share is combined before the shuffle.
    """
    first = calls.groupBy("key").agg(F.min("seq").alias("first"))
    joined = calls.join(first, "key")
    hit = F.col("seq") != F.col("first")
    return joined.select("key", "seq", hit.alias("cache_hit"), F.when(hit, F.lit(0.0)).otherwise(F.col("price")).alias("cost"))


def estimate(jobs: DataFrame, engines: Column, images: Column, ceiling: Column) -> DataFrame:
    """Cost of a job before it runs: the sum of its engines' prices, and whether it reaches the ceiling."""
    prices = F.create_map(*(F.lit(x) for pair in PRICES.items() for x in pair))
    each = F.round(F.aggregate(F.transform(engines, lambda e: F.coalesce(F.try_element_at(prices, e), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x), 6)
    return jobs.withColumns({"per_image": each, "estimate": F.round(each * images, 4), "over": F.round(each * images, 4) >= ceiling})


def memory_admission(megapixels: Column, concurrency: Column, ram_mb: Column) -> Column:
    """Peak memory of a run, whether it fits, and the concurrency that would."""
    each = megapixels * MB_PER_MEGAPIXEL
    usable = ram_mb - RESERVED_MB
    return F.struct(F.round(each * concurrency, 3).alias("peak_mb"), (each * concurrency <= usable).alias("fits"), F.greatest(F.lit(1), F.floor(usable / each)).cast("int").alias("suggested"))


def numbered_names(df: DataFrame, by: list[str], order: str, name: str, start_plain: bool = True) -> DataFrame:
    """Gives repeats of a name a number before the extension: a.png, a-1.png, a-2.png."""
    nth = F.row_number().over(Window.partitionBy(*by, name).orderBy(order)) - 1
    n = F.col(name)
    dotted = F.regexp_replace(n, r"(?s)^(.+)(\.[^.]*)$", F.concat(F.lit("$1-"), F.col("nth").cast("string"), F.lit("$2")))
    numbered = F.when(n.rlike(r"(?s)^.+\.[^.]*$"), dotted).otherwise(F.concat(n, F.lit("-"), F.col("nth").cast("string")))
    return df.withColumn("nth", nth).withColumn("unique_name", F.when(F.col("nth") == 0, n).otherwise(numbered)).drop("nth")
