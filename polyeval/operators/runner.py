"""Model runners.

A user callable (chat model, judge, translator) is run by ``mapInArrow``
over the input's partitions (or ``partitions`` hash-spread ones); each task
keeps a small thread pool of calls in flight, retries with back-off, and
returns one output row per input row (never loses a row). The last error
stays set even after a later success (``ok`` tells success apart). Only the
inputs of the calls become Python values, a bounded part of a batch at a time;
the other columns stay in Arrow.

Remote calls are not repeatable for free: the result is checkpointed into
the shared checkpoint folder (``materialize``) before it is used twice, so
neither a second action nor a lost executor sends the calls again.
"""

from __future__ import annotations

import hashlib
import math
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyeval.session import cut_lineage

MAX_TRIES = 10
RATE_LIMIT_BASE, RATE_LIMIT_FACTOR = 3.0, 2.0
GENERAL_BASE, GENERAL_FACTOR = 2.0, 1.5
BACKOFF_CAP = 60.0
TOKEN_LIMIT_TEXT = "Could not parse response content as the length limit was reached"


# ---------------------------------------------------------------------------
# B51 / B52 as column expressions (for reports over the run table)
# ---------------------------------------------------------------------------
def is_rate_limit(err: Column) -> Column:
    """Rate limit when the text has 'rate limit' (any case) or '429'."""
    e = F.coalesce(err, F.lit(""))
    return F.lower(e).contains("rate limit") | e.contains("429")


def status_code(err: Column) -> Column:
    """Integer after ``status_code=`` (up to the next blank), else null."""
    e = F.coalesce(err, F.lit(""))
    tok = F.regexp_extract(e, r"status_code=(\S+)", 1)
    return F.when(e.contains("status_code="), tok.try_cast("int"))


def jitter(key: Column, attempt: Column) -> Column:
    """Repeatable jitter in [0.8, 1.2) from the key and attempt."""
    frac = F.pmod(key * 7919 + attempt * 104729, F.lit(1000)) / F.lit(1000.0)
    return F.lit(0.8) + F.lit(0.4) * frac


def backoff(attempt: Column, rate_limited: Column, jit: Column) -> Column:
    """3*2^(n-1) (rate limit) or 2*1.5^(n-1) seconds, times the jitter,
    at most 60 (the cap applies after the jitter)."""
    base = F.when(rate_limited, F.lit(RATE_LIMIT_BASE) * F.pow(F.lit(RATE_LIMIT_FACTOR), attempt - 1)) \
        .otherwise(F.lit(GENERAL_BASE) * F.pow(F.lit(GENERAL_FACTOR), attempt - 1))
    return F.least(F.lit(BACKOFF_CAP), base * jit)


def _py_backoff(attempt: int, rate_limited: bool, key: int) -> float:
    frac = ((key * 7919 + attempt * 104729) % 1000) / 1000.0
    base = (RATE_LIMIT_BASE * RATE_LIMIT_FACTOR ** (attempt - 1) if rate_limited
            else GENERAL_BASE * GENERAL_FACTOR ** (attempt - 1))
    return min(BACKOFF_CAP, base * (0.8 + 0.4 * frac))


# ---------------------------------------------------------------------------
# J7 slot schedule
# ---------------------------------------------------------------------------
class SlotSchedule:
    """Turns of one lane. The job's limit cuts time into slots of one call each, counted
    from the clock's zero; lane ``lane`` of ``lanes`` owns every ``lanes``-th slot. A slot that
    has passed is lost, so the calls of all lanes together never come closer than the limit,
    whatever starts late. ``clock``/``sleep`` can be injected."""

    def __init__(self, per_minute: float, lane: int = 0, lanes: int = 1, clock=time.time, sleep=time.sleep):
        self.seconds = 60.0 / per_minute
        self.lane, self.lanes = lane, lanes
        self.clock, self.sleep = clock, sleep
        self.turn = -1
        self.lock = threading.Lock()
        self.waits = 0

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            first = math.ceil(now / self.seconds - 1e-9)
            self.turn = max(self.turn + 1, -(-(first - self.lane) // self.lanes))
            start = (self.turn * self.lanes + self.lane) * self.seconds
        # a sleep may end early; the turn is kept
        while (wait := start - self.clock()) > 1e-9:
            self.waits += 1
            self.sleep(max(wait, 1e-3))


# ---------------------------------------------------------------------------
# J1 runner
# ---------------------------------------------------------------------------
RUN_FIELDS = [T.StructField("response", T.StringType()), T.StructField("error", T.StringType()),
              T.StructField("attempts", T.IntegerType()), T.StructField("duration", T.DoubleType()),
              T.StructField("ok", T.BooleanType())]


# input values of one round of calls: as many rows as fit, at least one
PART_ROWS, PART_BYTES = 512, 4 << 20


def _parts(batch, inputs: list[str]):
    """Views of an Arrow batch, each of at most ``PART_ROWS`` rows and about ``PART_BYTES`` of inputs."""
    todo = [batch]
    while todo:
        part = todo.pop()
        n = part.num_rows
        if n > 1 and (n > PART_ROWS or sum(part.column(c).nbytes for c in inputs) > PART_BYTES):
            todo += [part.slice(n // 2), part.slice(0, n // 2)]
        elif n:
            yield part


def _stable_int(x) -> int:
    return int(hashlib.blake2b(str(x).encode(), digest_size=4).hexdigest(), 16)


def batch_infer(df: DataFrame, fn: Callable[..., str], inputs: list[str], key: str,
                max_tries: int = MAX_TRIES, concurrency: int = 4, partitions: int | None = None,
                calls_per_minute: float | None = None, sleep: Callable[[float], None] | None = None,
                clock: Callable[[], float] | None = None) -> DataFrame:
    """``fn(*row[inputs]) -> text`` for every row, with retries.

    Output = input columns + response, error, attempts, duration, ok.
    The input keeps its partitions unless ``partitions`` asks for a hash spread
    (a few large partitions, or one hot key). ``calls_per_minute`` limits the
    calls of the whole job, retries included: the rows are dealt over
    ``partitions`` lanes (the default parallelism where it is not given), and each
    lane calls in its own slots only (``SlotSchedule``; the machines' clocks must
    agree, and speculative execution must be off). ``sleep`` defaults to
    ``time.sleep``; a test that passes its own passes a clock that moves with it.
    """
    lanes = partitions or df.sparkSession.sparkContext.defaultParallelism
    if calls_per_minute is not None:
        partitions = lanes
    schema = T.StructType(list(df.schema.fields) + RUN_FIELDS)
    slp = sleep or time.sleep
    clk = clock or time.time

    def call(args, k, turns):
        err, attempts, t0 = None, 0, clk()
        while attempts < max_tries:
            attempts += 1
            if turns:
                turns.take()
            try:
                out = fn(*args)
                return out, err, attempts, clk() - t0, True
            except Exception as e:  # noqa: BLE001 - any failure is retried
                err = str(e)
                rl = "rate limit" in err.lower() or "429" in err
                if attempts < max_tries:
                    slp(_py_backoff(attempts, rl, _stable_int(k)))
        return None, err, attempts, clk() - t0, False

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        turns = None if calls_per_minute is None else SlotSchedule(
            calls_per_minute, TaskContext.get().partitionId(), lanes, clock=clk, sleep=slp)

        def one(args_k):
            return call(*args_k, turns)

        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                for part in _parts(batch, inputs):
                    cols = {c: part.column(c).to_pandas().tolist() for c in {*inputs, key}}
                    res = list(pool.map(one, zip(zip(*[cols[c] for c in inputs]), cols[key])))
                    # the input's own columns go back as they came
                    yield pa.RecordBatch.from_arrays(
                        part.columns + [pa.array(r, t) for r, t in zip(zip(*res), run_types())], names=schema.names)

    def run_types():
        import pyarrow as pa
        return [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.bool_()]

    if partitions:
        # by a hash of the whole request, so one hot key (a long conversation,
        # a large dataset) still lands on many tasks
        spread = F.xxhash64(F.col(key), *[F.col(c) for c in inputs])
        # lanes are partition numbers: they must not be joined or split afterwards
        df = (df.repartition(partitions, spread) if calls_per_minute is None
              else df.repartitionById(lanes, F.pmod(spread, F.lit(lanes)).cast("int")))
    return df.mapInArrow(run, schema)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a model-call result (shared checkpoint folder)."""
    return cut_lineage(df)


# ---------------------------------------------------------------------------
# J2 judge, J3 translate, J4 retry
# ---------------------------------------------------------------------------
def judge(df: DataFrame, fn: Callable[[str], dict], prompt: str, truth: str, answer: str,
          key: str, template: str | None = None, examples: list[dict] | None = None, **kw) -> DataFrame:
    """The judge prompt (instructions, worked examples, question, reference,
    answer) is rendered as column ``judge_prompt`` and handed to
    ``fn(judge_prompt) -> {verdict, reasoning}``. A token-limit error counts as
    Incorrect; any other error leaves blanks and the error."""
    import json

    from polyeval.functions import prompts as P

    def call(p):
        return json.dumps(fn(p))

    df = df.withColumn("judge_prompt", P.judge_prompt(
        F.col(prompt), F.col(truth), F.col(answer), template or P.JUDGE_TEMPLATE,
        P.JUDGE_EXAMPLES if examples is None else examples))
    r = batch_infer(df, call, ["judge_prompt"], key, **kw)
    parsed = F.from_json(F.col("response"), "struct<verdict:string,reasoning:string>")
    token_limit = F.coalesce(F.col("error"), F.lit("")).contains(TOKEN_LIMIT_TEXT)
    return (r.withColumn("_j", parsed)
             .withColumn("judge_verdict", F.when(F.col("ok"), F.coalesce(F.col("_j.verdict"), F.lit("")))
                         .when(token_limit, F.lit("Incorrect")).otherwise(F.lit("")))
             .withColumn("judge_reasoning", F.when(F.col("ok"), F.coalesce(F.col("_j.reasoning"), F.lit("")))
                         .when(token_limit, F.lit(TOKEN_LIMIT_TEXT)).otherwise(F.lit("")))
             .withColumn("judge_error", F.when(F.col("ok"), F.lit("")).otherwise(F.coalesce("error", F.lit(""))))
             .drop("_j", "response"))


def translate(df: DataFrame, fn: Callable[[str], str], request: str, key: str, **kw) -> DataFrame:
    """``fn(request) -> message``; parsing follows with column rules."""
    return batch_infer(df, fn, [request], key, **kw).withColumnRenamed("response", "message")


def retry_translate(translated: DataFrame, needs_retry: Column, fn: Callable[[str, float], str],
                    request: str, key: str, temperature: float = 1.0, **kw) -> DataFrame:
    """A second call at ``temperature`` for the rows ``needs_retry``
    selects (missing or overlong); the results replace those rows by key
    (D4), the other rows are kept as they are. ``retried`` marks them, for
    ``retry_status`` once the new messages are parsed."""
    # the first pass feeds two branches: cut its lineage so the model is not
    # called again for every row when both branches are computed
    translated = materialize(translated)
    todo = translated.where(needs_retry)
    keep = translated.where(~needs_retry | needs_retry.isNull())
    again = batch_infer(todo.drop("response", "error", "attempts", "duration", "ok", "message"),
                        lambda r: fn(r, temperature), [request], key, **kw).withColumnRenamed("response", "message")
    again = again.withColumn("retried", F.lit(True))
    return keep.withColumn("retried", F.lit(False)).unionByName(again, allowMissingColumns=True)


def retry_status(retried: Column, good: Column) -> Column:
    """Outcome of a record after the retry: translated, fixed or retry_failed."""
    return (F.when(~retried, F.when(good, "translated").otherwise("failed"))
            .when(good, "fixed").otherwise("retry_failed"))


# ---------------------------------------------------------------------------
# E7 / E18 summaries
# ---------------------------------------------------------------------------
def run_summary(runs: DataFrame) -> DataFrame:
    """Successes, failures, mean duration and mean attempts."""
    return runs.agg(F.count_if(F.col("ok")).alias("successes"), F.count_if(~F.col("ok")).alias("failures"),
                    F.avg("duration").alias("avg_duration"), F.avg("attempts").alias("avg_attempts"))


def time_per_entry(runs: DataFrame, cap: int | None = None) -> DataFrame:
    """Total time and mean per entry. ``cap`` reproduces scripts that
    divide by at most ``cap`` entries."""
    n = F.count(F.lit(1))
    denom = n if cap is None else F.least(n, F.lit(cap))
    return runs.agg(F.sum("duration").alias("total_time"), (F.sum("duration") / denom).alias("time_per_entry"))
