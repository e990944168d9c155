"""Registered runner queries (J1-J4, J7, B51-B52, E3 via J2, E7, E18).

The model is a user callable; the registered queries use deterministic
stand-ins so that results can be checked: the chat model answers with the
hash of the prompt, fails once with a rate-limit error on some ids and
always with a server error on others; the judge compares answer and truth;
the translator returns tagged JSON and leaves the tag out on some ids unless
called again at temperature 1.0. No call sleeps (injected no-op).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from polyeval.functions import prompts as P
from polyeval.functions import text as X
from polyeval.operators import joins as J
from polyeval.operators import runner as RN
from polyeval.operators import scoring as S
from polyeval.plans import oracle as O
from polyeval.plans.catalog import register
from polyeval.plans.fixtures import fx_chat, fx_responses, table, with_views

TRIES = 3
NO_SLEEP = dict(sleep=lambda s: None, clock=lambda: 0.0, max_tries=TRIES)


class VirtualClock:
    """A clock that moves when someone sleeps; each task has its own copy."""

    def __init__(self):
        self.time = 0.0

    def now(self):
        return self.time

    def sleep(self, seconds):
        self.time += seconds


class EchoModel:
    """Stand-in chat model: ``ANSWER:`` + the hash of the whole prompt. Some ids fail
    on their first call; it remembers only the calls that are under way."""

    def __init__(self):
        self.failed = set()

    def __call__(self, conv_id, turn, prompt):
        if conv_id % 17 == 0:
            raise RuntimeError("Error code: 500 status_code=500 server error")
        if conv_id % 5 == 0:
            if (conv_id, turn) not in self.failed:
                self.failed.add((conv_id, turn))
                raise RuntimeError("Error code: 429 rate limit exceeded")
            self.failed.discard((conv_id, turn))
        return "ANSWER:" + hashlib.sha256((prompt or "").encode("utf-8")).hexdigest()


class TimedModel(EchoModel):
    """The same, with every call one second long on a virtual clock."""

    def __init__(self, clock):
        super().__init__()
        self.clock = clock

    def __call__(self, conv_id, turn, prompt):
        self.clock.sleep(1.0)
        return super().__call__(conv_id, turn, prompt)


class SpacedModel(EchoModel):
    """The same, answering ``EARLY`` to calls that follow the one before by less than ``gap`` seconds."""

    def __init__(self, clock, gap):
        super().__init__()
        self.clock, self.gap, self.last = clock, gap, None

    def __call__(self, conv_id, turn, prompt):
        early = self.last is not None and self.clock.now() - self.last < self.gap - 1e-6
        self.last = self.clock.now()
        answer = super().__call__(conv_id, turn, prompt)
        return "EARLY" if early else answer


def _runs(spark, sf):
    c = fx_chat(spark, sf).select("conv_id", "turn", "prompt")
    return RN.batch_infer(c, EchoModel(), ["conv_id", "turn", "prompt"], "conv_id", **NO_SLEEP)


def _timed_runs(spark, sf):
    clock = VirtualClock()
    c = fx_chat(spark, sf).select("conv_id", "turn", "prompt")
    return RN.batch_infer(c, TimedModel(clock), ["conv_id", "turn", "prompt"], "conv_id", max_tries=TRIES,
                          concurrency=1, clock=clock.now, sleep=lambda s: None)


_RUNS_SQL = f"""SELECT conv_id, turn,
  CASE WHEN conv_id % 17 = 0 THEN NULL ELSE 'ANSWER:' || sha256(coalesce(prompt, '')) END AS response,
  CASE WHEN conv_id % 17 = 0 THEN 'Error code: 500 status_code=500 server error'
       WHEN conv_id % 5 = 0 THEN 'Error code: 429 rate limit exceeded' END AS error,
  CAST(CASE WHEN conv_id % 17 = 0 THEN {TRIES} WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
  conv_id % 17 <> 0 AS ok, CAST(0.0 AS DOUBLE) AS duration
FROM fx_chat"""

register("batch_infer", with_views(f"SELECT conv_id, turn, response, error, attempts, ok FROM ({_RUNS_SQL}) r",
                                   "fx_chat"))(
    lambda spark, sf: _runs(spark, sf).select("conv_id", "turn", "response", "error", "attempts", "ok"))

register("filter_failed_runs", with_views(f"SELECT conv_id, turn FROM ({_RUNS_SQL}) r WHERE response IS NULL",
                                          "fx_chat"))(
    lambda spark, sf: J.filter_failed(_runs(spark, sf)).select("conv_id", "turn"))

register("run_summary", with_views(f"""SELECT count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures,
  avg(duration) AS avg_duration, avg(attempts) AS avg_attempts FROM ({_RUNS_SQL}) r""", "fx_chat"))(
    lambda spark, sf: RN.run_summary(_runs(spark, sf)))

register("time_per_entry", with_views(f"""SELECT sum(duration) AS total_time, sum(duration) / count(*) AS time_per_entry
FROM (SELECT CAST(attempts AS DOUBLE) AS duration FROM ({_RUNS_SQL}) a) r""", "fx_chat"))(
    lambda spark, sf: RN.time_per_entry(_timed_runs(spark, sf)))

register("classify_error", with_views(f"""SELECT conv_id, turn,
  contains(lower(coalesce(error, '')), 'rate limit') OR contains(coalesce(error, ''), '429') AS rate_limited,
  CASE WHEN contains(coalesce(error, ''), 'status_code=') THEN
       TRY_CAST(regexp_extract(coalesce(error, ''), 'status_code=(\\S+)', 1) AS INTEGER) END AS status_code
FROM ({_RUNS_SQL}) r""", "fx_chat"))(
    lambda spark, sf: _runs(spark, sf).select("conv_id", "turn", RN.is_rate_limit(F.col("error")).alias("rate_limited"),
                                              RN.status_code(F.col("error")).alias("status_code")))


@register("backoff_schedule", with_views(f"""SELECT conv_id, turn, n AS attempt,
  round(least(60.0, (CASE WHEN rl THEN 3.0 * pow(2.0, n - 1) ELSE 2.0 * pow(1.5, n - 1) END)
        * (0.8 + 0.4 * (((conv_id * 1000 + turn) * 7919 + n * 104729) % 1000) / 1000.0)), 10) AS seconds
FROM (SELECT conv_id, turn, unnest(range(1, attempts)) AS n,
             contains(lower(coalesce(error, '')), 'rate limit') OR contains(coalesce(error, ''), '429') AS rl
      FROM ({_RUNS_SQL}) r WHERE attempts > 1) x""", "fx_chat"))
def q_backoff(spark, sf):
    r = _runs(spark, sf).where(F.col("attempts") > 1)
    e = r.select("conv_id", "turn", RN.is_rate_limit(F.col("error")).alias("rl"),
                 F.explode(F.sequence(F.lit(1).cast("bigint"), (F.col("attempts") - 1).cast("bigint"))).alias("attempt"))
    key = F.col("conv_id") * 1000 + F.col("turn")
    return e.select("conv_id", "turn", "attempt", F.round(RN.backoff(
        F.col("attempt"), F.col("rl"), RN.jitter(key, F.col("attempt"))), 10).alias("seconds"))


# --- J7 rate limit: on a virtual clock every call, retries included, waits for its token -------------
CALLS_PER_MINUTE = 30.0


@register("rate_limited_infer", with_views(f"SELECT conv_id, turn, response, attempts FROM ({_RUNS_SQL}) r", "fx_chat"))
def q_rate_limited(spark, sf):
    """Equal to ``batch_infer`` only because the bucket spaces the calls: the model
    answers EARLY to any call that comes before its turn."""
    clock = VirtualClock()
    c = fx_chat(spark, sf).select("conv_id", "turn", "prompt")
    at_once = spark.sparkContext.defaultParallelism
    model = SpacedModel(clock, 60.0 / CALLS_PER_MINUTE)
    return RN.batch_infer(c, model, ["conv_id", "turn", "prompt"], "conv_id", max_tries=TRIES, concurrency=1,
                          calls_per_minute=CALLS_PER_MINUTE * at_once, clock=clock.now, sleep=clock.sleep) \
        .select("conv_id", "turn", "response", "attempts")


# --- J2 judge and E3 over its verdicts -------------------------------------------------------------
def rule_judge(judge_prompt):
    """Stand-in judge: reads reference and answer from the end of the rendered prompt."""
    head, _, answer = judge_prompt.rpartition("\n\nModel answer:\n")
    truth = head.rpartition("\n\nReference answer:\n")[2]
    answer = answer[:-1]
    if "not sure" in (answer or ""):
        raise RuntimeError(RN.TOKEN_LIMIT_TEXT)
    verdict = "Correct" if answer == truth else "Incorrect"
    return {"verdict": verdict, "reasoning": "compared with the reference answer"}


def _judged(spark, sf):
    r = fx_responses(spark, sf).select("question_id", "dataset", "lang", "model", "prompt", "ground_truth",
                                       S.strip_reasoning(F.col("response")).alias("answer"))
    return RN.judge(r, rule_judge, "prompt", "ground_truth", "answer", "question_id", **NO_SLEEP)


_JUDGE_SQL = f"""SELECT question_id, dataset, lang, model,
  CASE WHEN contains(c, 'not sure') THEN 'Incorrect' WHEN c = ground_truth THEN 'Correct' ELSE 'Incorrect' END AS judge_verdict,
  CASE WHEN contains(c, 'not sure') THEN '{RN.TOKEN_LIMIT_TEXT}' ELSE 'compared with the reference answer' END AS judge_reasoning,
  CASE WHEN contains(c, 'not sure') THEN '{RN.TOKEN_LIMIT_TEXT}' ELSE '' END AS judge_error
FROM (SELECT f.*, {O.clean('f.response')} AS c FROM fx_responses f) x"""

def _judge_table_sql():
    from polyeval.plans.q_prompts import judge_prompt_expr
    return with_views(f"""SELECT j.question_id, judge_verdict, judge_reasoning, judge_error, md5({judge_prompt_expr()}) AS prompt_md5
FROM ({_JUDGE_SQL}) j JOIN (SELECT f.question_id, f.prompt, f.ground_truth, {O.clean('f.response')} AS c FROM fx_responses f) p
  ON p.question_id = j.question_id""", "fx_responses")


register("judge", _judge_table_sql())(
    lambda spark, sf: _judged(spark, sf).select("question_id", "judge_verdict", "judge_reasoning", "judge_error",
                                                F.md5("judge_prompt").alias("prompt_md5")))

register("judge_accuracy_runner", with_views(f"""SELECT dataset, lang, model,
  coalesce(CAST(count(*) FILTER (WHERE judge_verdict = 'Correct') AS DOUBLE) / count(*), 0.0) AS judge_accuracy
FROM ({_JUDGE_SQL}) j GROUP BY dataset, lang, model""", "fx_responses"))(
    lambda spark, sf: S.judge_accuracy(_judged(spark, sf), ("dataset", "lang", "model")))


# --- J3 translate, J4 retry ----------------------------------------------------------------------------
GUIDE = "Translate the JSON values above into Bangla. Keep the keys."


class FakeTranslator:
    """Digits to Bangla digits and a prefix; fails on some ids; breaks the JSON on
    others, at temperature 1.0 only on some of them."""

    def __call__(self, request, temperature=0.0):
        body = request.split("<english_text>\n", 1)[1].split("\n</english_text>", 1)[0]
        fields = json.loads(body)
        idx = int(fields["idx"])
        if idx % 13 == 0:
            raise RuntimeError("Error code: 503 status_code=503 unavailable")
        q = "বাংলা: " + (fields["question"] or "").translate(str.maketrans("0123456789", "০১২৩৪৫৬৭৮৯"))
        out = json.dumps({"question": q}, ensure_ascii=False)
        if idx % 11 == 0 or idx % 7 == 0 and temperature != 1.0:
            return f"<bangla_translation>{out[:-1]}</bangla_translation>"
        return f"ok <bangla_translation>\n{out}\n</bangla_translation><translator_notes>n</translator_notes>"


def _requests(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("question"))
    req = P.translation_request({"idx": F.col("idx"), "question": F.col("question")}, GUIDE, "dumped")
    return d.select("idx", "question", req.alias("request"))


def _parsed(df):
    t = X.strip_notes(X.extract_tag("message", "bangla_translation", "whole"))
    return df.withColumn("translated", X.parse_json_strict(t, "struct<question:string>")["question"])


def _translated(spark, sf):
    fake = FakeTranslator()
    return _parsed(RN.translate(_requests(spark, sf), fake, "request", "idx", **NO_SLEEP))


def _final(df):
    return df.select("idx", F.coalesce("translated", "question").alias("question"),
                     F.when(F.col("translated").isNotNull(), "translated").otherwise("original").alias("status"))


_TR = "'বাংলা: ' || translate(text, '0123456789', '০১২৩৪৫৬৭৮৯')"
_FAILS = "(doc_id % 13 = 0 OR doc_id % 11 = 0)"
register("translate", f"""SELECT doc_id AS idx, CASE WHEN bad THEN text ELSE {_TR} END AS question,
  CASE WHEN bad THEN 'original' ELSE 'translated' END AS status
FROM (SELECT *, {_FAILS} OR doc_id % 7 = 0 AS bad FROM documents) d""")(
    lambda spark, sf: _final(_translated(spark, sf)))


def _overlong():
    # more than three times longer than the original
    return F.coalesce(X.length_ratio_flag(F.length("translated"), F.length("question")), F.lit(False))


@register("retry_translate", f"""SELECT doc_id AS idx, CASE WHEN {_FAILS} THEN text ELSE {_TR} END AS question,
  CASE WHEN {_FAILS} THEN 'retry_failed' WHEN too_long THEN 'retry_failed' WHEN doc_id % 7 = 0 THEN 'fixed'
       ELSE 'translated' END AS status
FROM (SELECT *, coalesce(length({_TR}) > 3.0 * length(text), false) AS too_long
      FROM documents) d""")
def q_retry(spark, sf):
    first = _translated(spark, sf)
    fake = FakeTranslator()
    needs = F.col("translated").isNull() | _overlong()
    both = _parsed(RN.retry_translate(first, needs, lambda r, t: fake(r, t), "request", "idx",
                                      temperature=1.0, **NO_SLEEP).drop("translated"))
    good = F.col("translated").isNotNull() & ~_overlong()
    return both.select("idx", F.coalesce("translated", "question").alias("question"),
                       RN.retry_status(F.col("retried"), good).alias("status"))
