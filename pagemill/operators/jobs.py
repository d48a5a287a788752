"""Jobs and tasks as tables: validation, records, outcomes, recounts, retries, pacing, idempotency."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..session import kept
from .folds import Fold, State, folded
from .ratelimit import anchored_window

# --- fixed values --------------------------------------------------------------------
MAX_TASKS, MAX_SELECTOR, MAX_RESULT_BYTES = 100, 256, 16_000
CRAWL_KEYS = ["url", "format", "selector", "force_browser", "no_cache"]
EXTRACT_KEYS = ["strategy", "schema", "url", "html", "input", "selector", "force_browser", "no_cache", "include_markdown", "options"]
FORMATS, STRATEGIES = ["markdown", "html", "text", "json"], ["css", "xpath", "regex"]
RATE_LIMIT_STATUSES = (429, 503)
# -------------------------------------------------------------------------------------


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _kind(v: Column, path: str = "") -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, a number's type, VOID for null; SQL null where absent."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, f"$.{path}" if path else "$", "variant")), "^[A-Z]+", 0)


def _filled(v: Column, path: str) -> Column:
    return (_kind(v, path) == "STRING") & (F.trim(_get(v, path, "string")) != "")


def _keys(v: Column) -> Column:
    return F.map_keys(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def validate(jobs: DataFrame, text: str = "json") -> DataFrame:
    """``jobs`` with error_code, error_message, error_index and error_field: the first fault of each payload, or nulls.

    Payload faults come before task faults; of the tasks, the first faulty one counts.
    """
    v = F.try_parse_json(F.col(text))
    made = jobs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__v", v).withColumn("__tasks", _get(F.col("__v"), "tasks", "array<variant>"))
    no = lambda c: F.coalesce(~c, F.lit(True))
    head = F.coalesce(
        F.when(no(_kind(F.col("__v")) == "OBJECT"), "Job payload must be a JSON object."),
        F.when(no((_kind(F.col("__v"), "type") == "STRING") & _get(F.col("__v"), "type", "string").isin("crawl", "extract")), "type must be either crawl or extract."),
        F.when(no(F.size("__tasks") > 0), "tasks must be a non-empty array."),
        F.when(F.size("__tasks") > MAX_TASKS, f"Maximum {MAX_TASKS} tasks allowed per job."),
    )
    made = made.withColumn("__head", head).withColumn("__type", _get(F.col("__v"), "type", "string"))
    faults = F.transform(F.col("__tasks"), lambda t, i: F.struct(i.alias("i"), _task_fault(t, F.col("__type")).alias("f")))
    bad = F.get(F.filter(faults, lambda x: x["f"]["message"].isNotNull()), F.lit(0))
    made = made.withColumn("__bad", F.when(F.col("__head").isNull(), bad))
    message = F.coalesce("__head", F.col("__bad.f.message"))
    return made.select(*jobs.columns, F.when(message.isNotNull(), "INVALID_REQUEST").alias("error_code"), message.alias("error_message"), F.col("__bad.i").alias("error_index"), F.col("__bad.f.field").alias("error_field"))


def _task_fault(t: Column, job: Column) -> Column:
    """struct(message, field) of one task of a job type; nulls where it is sound."""
    is_text, is_object = _kind(t) == "STRING", _kind(t) == "OBJECT"
    crawl, extract = job == "crawl", job == "extract"
    odd = F.get(F.filter(_keys(t), lambda k: ~k.isin(CRAWL_KEYS) & crawl | ~k.isin(EXTRACT_KEYS) & extract), F.lit(0))
    there = lambda p: _kind(t, p).isNotNull()
    wrong = lambda p, kind: there(p) & (_kind(t, p) != kind)
    name = F.concat(job, F.lit(" task "))
    source = lambda p: _filled(t, p) | (_kind(t, "input") == "OBJECT") & _filled(t, f"input.{p}")
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        (is_text & extract, "extract task must be an object."),
        (is_text & (F.trim(F.try_variant_get(t, "$", "string")) == ""), "crawl task string entries must be non-empty URLs."),
        (~is_text & ~is_object, "Each task must be either a string or an object."),
        (is_object & crawl & (F.coalesce(_kind(t, "url"), F.lit("")) != "STRING"), "crawl task object must include url."),
        (is_object & odd.isNotNull(), F.concat(name, F.lit("contains unsupported field: "), odd, F.lit("."))),
        (is_object & crawl & ~yes(_filled(t, "url")), "crawl task url must be a non-empty string."),
        (crawl & there("format") & ~yes((_kind(t, "format") == "STRING") & _get(t, "format", "string").isin(FORMATS)), "crawl task format must be one of: markdown, html, text, json."),
        (is_object & extract & (F.coalesce(_kind(t, "strategy"), F.lit("")) != "STRING"), "extract task must include strategy."),
        (is_object & extract & ~yes(_get(t, "strategy", "string").isin(STRATEGIES)), "extract task strategy must be one of: css, xpath, regex."),
        (is_object & extract & (F.coalesce(_kind(t, "schema"), F.lit("")) != "OBJECT"), "extract task must include schema object."),
        (wrong("selector", "STRING"), F.concat(name, F.lit("selector must be a string."))),
        (F.length(_get(t, "selector", "string")) > MAX_SELECTOR, F.concat(name, F.lit(f"selector is too long (max {MAX_SELECTOR} characters)."))),
        *((wrong(p, "BOOLEAN"), F.concat(name, F.lit(f"{p} must be a boolean."))) for p in ("force_browser", "no_cache")),
        (extract & wrong("include_markdown", "BOOLEAN"), "extract task include_markdown must be a boolean."),
        (extract & wrong("options", "OBJECT"), "extract task options must be an object."),
        (is_object & extract & ~yes(source("url")) & ~yes(source("html")), "extract task must include a non-empty url or html source."),
    ]
    message = F.coalesce(*(F.when(yes(c), m if isinstance(m, Column) else F.lit(m)) for c, m in checks))
    return F.struct(message.alias("message"), F.when(message.contains("unsupported field"), odd).alias("field"))


def records(jobs: DataFrame, text: str = "json") -> DataFrame:
    """One queued row for each task of the sound payloads: job_id, type, priority, max_retries, task, url, input, status, retry_count."""
    sound = validate(jobs, text).where("error_code is null")
    v = F.try_parse_json(F.col(text))
    made = sound.select("job_id", v.alias("v"))
    head = made.select("job_id", _get(F.col("v"), "type", "string").alias("type"), classify.priority(_get(F.col("v"), "priority", "double")).alias("priority"), classify.max_retries(_get(F.col("v"), "maxRetries", "double")).alias("max_retries"), F.posexplode(_get(F.col("v"), "tasks", "array<variant>")).alias("task", "t"))
    return head.select("job_id", "type", "priority", "max_retries", "task", task_url(F.col("t")).alias("url"), F.to_json("t").alias("input"), F.lit("queued").alias("status"), F.lit(0).alias("retry_count"))


def task_url(t: Column) -> Column:
    """The trimmed URL of a task that is a string or an object, or null."""
    own = F.when(_kind(t) == "STRING", F.try_variant_get(t, "$", "string")).when(_kind(t, "url") == "STRING", _get(t, "url", "string"))
    return F.nullif(F.trim(own), F.lit(""))


def batch_items(items: DataFrame, text: str = "json") -> DataFrame:
    """Batch entries (a string or an object with url) as url, format, selector, force_browser, no_cache; a null url marks an unusable entry."""
    v = F.try_parse_json(F.col(text))
    fmt = _get(v, "format", "string")
    return items.select(*items.columns, task_url(v).alias("url"), F.when(fmt.isin(FORMATS), fmt).otherwise("markdown").alias("format"), _get(v, "selector", "string").alias("selector"), F.coalesce(_get(v, "force_browser", "boolean"), F.lit(False)).alias("force_browser"), F.coalesce(_get(v, "no_cache", "boolean"), F.lit(False)).alias("no_cache"))


def job_status(total: Column, running: Column, succeeded: Column, failed: Column, queued: Column, canceled: Column) -> Column:
    return F.when(running > 0, "running").when(succeeded == total, "succeeded").when((failed > 0) & (queued == 0), "failed").when(canceled == total, "canceled").otherwise("queued")


def recount(tasks: DataFrame, job: str = "job_id") -> DataFrame:
    """Counts of each status, retries and the derived status of every job, by one partial aggregation."""
    names = ("succeeded", "failed", "queued", "running", "canceled")
    counts = tasks.groupBy(job).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == n).alias(n) for n in names), F.sum(F.greatest(F.lit(0), F.coalesce("retry_count", F.lit(0)))).alias("retries"))
    return counts.withColumn("status", job_status(*(F.col(c) for c in ("total", "running", "succeeded", "failed", "queued", "canceled"))))


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks left running by an interrupted run, as failed."""
    was = F.col("status") == "running"
    return tasks.withColumns({"error": F.when(was, F.coalesce(F.nullif("error", F.lit("")), F.lit("Previous run was interrupted."))).otherwise(F.col("error")), "status": F.when(was, "failed").otherwise(F.col("status"))})


def outcomes(attempts: DataFrame, most: Column | int, task: str = "task_id") -> DataFrame:
    """(task, attempts, success, status_code) of logged attempts (attempt from 1, status_code, success), as a run with ``most`` retries would end.

    A run ends at the first success, or at a failure that is not worth a retry or has none left.
    """
    most = most if isinstance(most, Column) else F.lit(most)
    again = F.col("status_code").isNull() | F.col("status_code").isin(*RATE_LIMIT_STATUSES)
    ends = F.col("success") | ~again | (F.col("attempt") > most)
    end = F.struct("attempt", "success", "status_code")
    done = attempts.groupBy(task).agg(F.min_by(end, F.when(ends, F.col("attempt"))).alias("stop"), F.max_by(end, "attempt").alias("last"))
    x = F.coalesce("stop", "last")
    return done.select(task, x["attempt"].alias("attempts"), F.coalesce(x["success"], F.lit(False)).alias("success"), x["status_code"].alias("status_code"))


def settled(items: DataFrame, run: Callable[[dict], str | None], limit: int = 5, place: str = "place") -> DataFrame:
    """``items`` with status (fulfilled, rejected), value and reason of running each, at most ``limit`` at a time, whatever the others do.

    ``place`` tells an item's order; results are rows, so it is kept, not awaited.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in items.schema)}, status string, value string, reason string"

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = []
            for row in b.to_dict("records"):
                try:
                    ends.append(("fulfilled", run(row), None))
                except Exception as e:  # an item's failure is its result
                    ends.append(("rejected", None, str(e)))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(ends, columns=["status", "value", "reason"], dtype=object)], axis=1)

    return items.repartition(limit, place).mapInPandas(step, schema)


def attempted(tasks: DataFrame, execute: Callable[[dict], tuple[int, str | None]], most: int = 2, limit: int = 5, task: str = "task_id") -> DataFrame:
    """(task, attempt, success, status_code, error, result) of running every task by ``execute``, which gives a status code and a result or fails.

    A code below 400 is a success; failures without a code, and those worth it, are tried
    again up to ``most`` times. The rows are what ``outcomes`` reads.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                for n in range(1, most + 2):
                    try:
                        code, result, error = *execute(row), None
                    except Exception as e:  # a failure without a code
                        code, result, error = None, None, str(e)
                    good = code is not None and code < 400
                    rows.append((row[task], n, good, code, error if code is None else None if good else f"HTTP {code}", result if good else None))
                    if good or (code is not None and code not in RATE_LIMIT_STATUSES):
                        break
            yield pd.DataFrame(rows, columns=[task, "attempt", "success", "status_code", "error", "result"]).astype({"status_code": "Int32"})

    kind = dict(tasks.dtypes)[task]
    return tasks.repartition(limit, task).mapInPandas(step, f"`{task}` {kind}, attempt int, success boolean, status_code int, error string, result string")


def claims(requests: DataFrame, seconds: int = 60, job: str = "job_id", run: str = "run_id", at: str = "ts") -> DataFrame:
    """(job, run, ts, granted) of requests to run a job: one run holds it for ``seconds``, others are refused meanwhile."""
    return anchored_window(requests, job, at, 1, seconds, run).select(job, run, at, (F.col("hit") == 1).alias("granted"))


def merged(tasks: DataFrame, results: DataFrame, task: str = "task_id") -> DataFrame:
    """Tasks with the outcomes of a run: status, retries, error, and the result unless it is too large."""
    r = results.select(task, F.col("attempts").alias("__n"), F.col("success").alias("__ok"), F.col("error").alias("__e"), F.col("result").alias("__r"))
    ran = F.col("__n").isNotNull()
    return tasks.join(r, task, "left").withColumns(
        {
            "retry_count": F.coalesce("retry_count", F.lit(0)) + F.when(ran, F.greatest(F.lit(0), F.col("__n") - 1)).otherwise(0),
            "status": F.when(ran, F.when(F.col("__ok"), "succeeded").otherwise("failed")).otherwise(F.col("status")),
            "error": F.when(ran, F.when(~F.col("__ok"), F.coalesce(F.nullif("__e", F.lit("")), F.lit("Task failed")))).otherwise(F.col("error")),
            "result": F.when(ran, F.when(F.col("__ok"), stored_result(F.col("__r")))).otherwise(F.col("result")),
        }
    ).drop("__n", "__ok", "__e", "__r")


def stored_result(result: Column, most: int = MAX_RESULT_BYTES) -> Column:
    """JSON results beyond ``most`` bytes become their size."""
    n = F.octet_length(result)
    return F.when(n > most, F.to_json(F.struct(F.lit(True).alias("truncated"), n.alias("bytes")))).otherwise(result)


def summary(jobs: DataFrame) -> DataFrame:
    """The public row of a job, with defaults for what is missing."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return jobs.select("job_id", "type", "status", *map(zero, ("total", "succeeded", "failed", "queued", "running", "canceled", "retries")), F.coalesce("priority", F.lit(10)).alias("priority"), F.coalesce("max_retries", F.lit(2)).alias("max_retries"))


def stable_json(value: Any) -> str:
    """JSON with keys in order at every level."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def payload_hash(text: Column) -> Column:
    """SHA-256 of a JSON payload, whatever the order of its keys."""

    @F.pandas_udf("string")
    def ordered(values: pd.Series) -> pd.Series:
        def one(t):
            try:
                return stable_json(json.loads(t))
            except (TypeError, ValueError):
                return t

        return values.map(one)

    return F.sha2(ordered(text), 256)


def idempotent(creates: DataFrame, key: str = "idem_key", at: str = "ts", payload: str = "payload_hash", tie: str | None = None) -> DataFrame:
    """Each create with ``outcome``: created (first of its key), replayed (same payload) or conflict (another payload).

    The first of every key is found by a partial aggregation, not by ordering all
    creates of a key in one task. Of creates of one time the least ``tie`` is first, then
    the least payload; of rows equal in all that, exactly one is created and the others
    are replayed. Creates without a key are all created; null payloads equal each other.
    """
    marked = kept(creates.withColumn("__row", F.monotonically_increasing_id()))
    order = F.struct(F.col(at).alias("at"), *([F.col(tie).alias("tie")] if tie else []), F.col(payload).alias("payload"), "__row")
    first = marked.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    made = marked.join(first, key, "left")
    same_row, same = F.col("__row") == F.col("__first.__row"), F.col(payload).eqNullSafe(F.col("__first.payload"))
    outcome = F.when(F.col(key).isNull() | same_row, "created").when(same, "replayed").otherwise("conflict")
    return made.withColumn("outcome", outcome).select(*creates.columns, "outcome")


def _pacing(base_ms: int, most_ms: int) -> Fold:
    """The delay is the state; an attempt maps it to another, and more delay before never means less after."""

    def moved(delay: np.ndarray, ok: bool, jitter: float) -> np.ndarray:
        return np.maximum(base_ms, np.floor(delay * 0.75)) if ok else np.minimum(most_ms, np.floor(delay * 2 * jitter))

    def summed(rows: pd.DataFrame) -> list[np.ndarray]:
        """The block as a step function: from which delay on, which delay comes out."""
        starts = np.arange(base_ms, most_ms + 1)
        delay = starts.astype(float)
        for ok, jitter in zip(rows["success"].to_numpy(), rows["__jitter"].to_numpy(), strict=True):
            delay = moved(delay, ok, jitter)
            if len(delay) > 1:
                own = np.r_[True, delay[1:] != delay[:-1]]
                starts, delay = starts[own], delay[own]
        return [starts, delay.astype(np.int64)]

    def passed(state: State, arrays: list[np.ndarray], n: int) -> State:
        starts, delay = arrays
        return (int(delay[np.searchsorted(starts, state[0], side="right") - 1]),)

    def stepped(state: State, rows: pd.DataFrame) -> tuple[State, dict[str, np.ndarray]]:
        delay, out = state[0], np.empty(len(rows), np.int64)
        for i, (ok, jitter) in enumerate(zip(rows["success"].to_numpy(), rows["__jitter"].to_numpy(), strict=True)):
            delay = max(base_ms, int(delay * 0.75)) if ok else min(most_ms, int(delay * 2 * jitter))
            out[i] = delay
        ok = rows["success"].to_numpy(bool)
        return (delay,), {"delay_ms": out, "wait_ms": np.where(ok, np.minimum(base_ms, out), out)}

    return Fold((base_ms,), ["success", "__jitter"], summed, passed, stepped, "delay_ms long, wait_ms long")


def paced(attempts: DataFrame, base_ms: int = 1000, most_ms: int = 30_000, seed: int = 0) -> DataFrame:
    """Delays of each domain after each attempt (domain, seq, success): shrunk by a quarter after a success, doubled with jitter after a failure.

    A fold in order of ``seq`` for each domain, failures first among equals, in blocks
    (see ``folds``), so a domain of any number of attempts splits. The jitter, 0.75 to
    1.25, is a digest of ``seed``, the domain and ``seq``, so a run can be repeated. Adds
    delay_ms and wait_ms. A null success is a failure; null domains are one domain.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("domain"), F.col("seq").cast("string")))
    jitter = 0.75 + F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 33))
    rows = attempts.select("domain", F.col("seq").cast("long").alias("seq"), F.coalesce("success", F.lit(False)).alias("success"), jitter.alias("__jitter"))
    return folded(rows, "domain", ["seq", "success"], _pacing(max(50, base_ms), max(50, base_ms, most_ms))).drop("__jitter")


def changes(history: DataFrame, key: str, at: str, status: str = "status") -> DataFrame:
    """Rows where a status differs from the one before it; ``valid`` tells whether the move is allowed."""
    w = Window.partitionBy(key).orderBy(at)
    before = F.lag(status).over(w)
    made = history.withColumn("previous", before)
    return made.where(F.col("previous").isNull() | (F.col("previous") != F.col(status))).withColumn("valid", F.col("previous").isNull() | classify.valid_move(F.col("previous"), F.col(status)))
