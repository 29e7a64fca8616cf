"""Batch inference surface (I1-I7): user code runs in Arrow batches inside tasks.

* ``map_rows`` / ``filter_rows`` — user Python over pandas batches (``mapInPandas``).
* ``predict_labels`` / ``predict_relevance`` — a user predictor, built once per Python
  worker from a factory, scores padded sequences in fixed-size batches; only the best
  classes come back unless the scores are asked for (then ``argmax_labels`` and
  ``batch_loss`` work on them natively).
* ``generate_candidates`` — a user text-generation client called per partition with
  retry / back-off inside the worker; every failure becomes data (n failure rows).
* ``token_count_udf`` — a Pandas UDF around a user tokenizer.
Concurrency against an external service is bounded by the number of partitions
(``df.repartition(p)`` before the call)."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections import OrderedDict
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.session import ensure_library_on_workers

_WORKER_CACHE: OrderedDict = OrderedDict()
_WORKER_CACHE_SIZE = 4
#: Rows of predictions that a worker holds before they leave it.
OUT_ROWS = 256


def _cached(token: str, factory: Callable):
    """Build the user object once per operator call and Python worker process (workers are
    reused).  ``token`` is made on the driver for each call, so two calls never share an
    object whatever their factories look like; the oldest objects are dropped."""
    if token not in _WORKER_CACHE:
        _WORKER_CACHE[token] = factory()
    _WORKER_CACHE.move_to_end(token)
    while len(_WORKER_CACHE) > _WORKER_CACHE_SIZE:
        _WORKER_CACHE.popitem(last=False)
    return _WORKER_CACHE[token]


# I1 ---------------------------------------------------------------------------------
def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply a user pandas function to every batch (adds / replaces columns)."""
    ensure_library_on_workers(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, predicate: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Keep the rows for which a user pandas predicate is true (evaluated in batches)."""
    ensure_library_on_workers(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[predicate(b).astype(bool).values]
    return df.mapInPandas(run, df.schema)


# I2 / I3 -------------------------------------------------------------------------------
def _score(df: DataFrame, factory: Callable, inputs: list[str], predicted: T.DataType, scores: T.DataType,
           scores_col: str | None, batch_size: int) -> DataFrame:
    """Model scores per row, reduced to the best class (lowest on ties) as each model batch is
    answered; the scores themselves leave the worker only when ``scores_col`` asks for them.
    Only the inputs become Python objects, one model batch at a time: all columns pass through
    as Arrow, ``OUT_ROWS`` rows at a time.  Select the columns needed downstream first."""
    fields = [f for f in df.schema.fields if f.name not in ("predicted", scores_col)]
    keep = [f.name for f in fields]
    fields.append(T.StructField("predicted", predicted))
    if scores_col:
        fields.append(T.StructField(scores_col, scores))
    schema = T.StructType(fields)
    names = schema.fieldNames()
    ensure_library_on_workers(df.sparkSession)
    token = uuid.uuid4().hex
    nested = isinstance(predicted, T.ArrayType)
    step = batch_size * max(1, OUT_ROWS // batch_size)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        classes = pa.list_(pa.int32()) if nested else pa.int32()
        numbers = pa.list_(pa.list_(pa.float64())) if nested else pa.list_(pa.float64())
        model = _cached(token, factory)
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                best, outs = [], []
                for s in range(0, part.num_rows, batch_size):
                    chunk = part.slice(s, batch_size)
                    for o in model({c: list(chunk.column(c).to_pandas(date_as_object=True)) for c in inputs}):
                        best.append(np.argmax(np.asarray(o), axis=-1).astype("int32"))
                        if scores_col:
                            outs.append(np.asarray(o, "float64").tolist())
                        o = None
                cols = [*(part.column(c) for c in keep), pa.array(best, classes)]
                if scores_col:
                    cols.append(pa.array(outs, numbers))
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return df.mapInArrow(run, schema)


def predict_labels(df: DataFrame, predictor_factory: Callable, inputs=("ids", "segments", "mask"),
                   batch_size: int = 4, out_col: str | None = None) -> DataFrame:
    """The best class per position, ``predicted``, from a user predictor's class scores
    (kept as ``array<array<double>>`` when ``out_col`` names a column for them).

    ``predictor_factory()`` returns ``f(batch: dict[str, list]) -> list[list[list[float]]]``."""
    return _score(df, predictor_factory, list(inputs), T.ArrayType(T.IntegerType()),
                  T.ArrayType(T.ArrayType(T.DoubleType())), out_col, batch_size)


def predict_relevance(df: DataFrame, predictor_factory: Callable, inputs=("ids", "segments", "mask"),
                      batch_size: int = 16, out_col: str | None = None) -> DataFrame:
    """Two-class scores per block; ``predicted`` = argmax (lowest index on ties)."""
    return _score(df, predictor_factory, list(inputs), T.IntegerType(), T.ArrayType(T.DoubleType()),
                  out_col, batch_size)


# I7 ------------------------------------------------------------------------------------
def token_count_udf(tokenizer: Callable[[str], list]) -> Callable[[Column], Column]:
    """A Pandas UDF counting tokens with a user tokenizer (e.g. a BPE encoder's ``encode``)."""
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_library_on_workers(active)

    @F.pandas_udf(T.IntegerType())
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(tokenizer(x))).astype("Int32")
    # marked non-deterministic so a count used in a filter and in the output is computed
    # once (otherwise the planner evaluates the UDF in two Python nodes)
    return count.asNondeterministic()


# I5 / I6 --------------------------------------------------------------------------------
class RateLimitError(Exception):
    """Raise from a client to signal a rate limit (retried with back-off)."""


class APIError(Exception):
    """Raise from a client for a transient service error (retried with back-off)."""


class InvalidRequestError(Exception):
    """Raise from a client for a rejected request (not retried)."""


RESPONSE = T.StructType([T.StructField("text", T.StringType()),
                         T.StructField("finish_reason", T.StringType()),
                         T.StructField("success", T.BooleanType())])


def _failure(reason: str, n: int) -> list[dict]:
    return [{"text": None, "finish_reason": reason, "success": False} for _ in range(n)]


def call_with_retry(client, prompts: list[str], n: int, instructions: list[str] | None = None, *,
                    max_attempts: int = 8, timeout: float = 1.0, timeout_mf: float = 2.0,
                    retry_when_blank: bool = False, sleep: Callable[[float], None] = time.sleep
                    ) -> list[list[dict]]:
    """One request for a batch of prompts; returns one list of n responses per prompt.

    Rate-limit and API errors are retried up to ``max_attempts`` times, waiting
    ``timeout * timeout_mf ** attempt``; a blank answer is retried without delay when
    ``retry_when_blank``; a wrong number of choices, an invalid request or any other
    error is recorded at once.  Failures are n rows with ``success = false``."""
    attempt, wait = 0, timeout
    k = len(prompts)
    while True:
        try:
            choices = client(prompts, n, instructions)
            if len(choices) != k * n:
                raise RuntimeError("unexpected number of choices")
            if retry_when_blank and any((c.get("text") or "").strip() == "" for c in choices):
                if attempt < max_attempts:
                    attempt += 1
                    continue
                return [_failure("Blank Response", n) for _ in range(k)]
            reason = "edit done" if instructions else None  # what an edit reports
            return [[{"text": c.get("text"), "finish_reason": reason or c.get("finish_reason"), "success": True}
                     for c in choices[i * n:(i + 1) * n]] for i in range(k)]
        except (RateLimitError, APIError) as e:
            if attempt < max_attempts:
                attempt += 1
                wait *= timeout_mf
                sleep(wait)
                continue
            reason = "RateLimit" if isinstance(e, RateLimitError) else "APIError"
            return [_failure(reason, n) for _ in range(k)]
        except InvalidRequestError:
            return [_failure("InvalidRequest", n) for _ in range(k)]
        except Exception:  # noqa: BLE001 - any other client error is recorded as data
            return [_failure("Error", n) for _ in range(k)]


def generate_candidates(df: DataFrame, client_factory: Callable, n: int, prompt_col: str = "prompt",
                        instruction_col: str | None = None, prompt_batch_size: int = 1,
                        max_attempts: int = 8, timeout: float = 1.0, timeout_mf: float = 2.0,
                        retry_when_blank: bool = False, pause_after_batch: float | None = None,
                        sleep: Callable[[float], None] = time.sleep, out_col: str = "cands") -> DataFrame:
    """I5 (and I6 with ``instruction_col``): n candidates per prompt from a user client.

    ``client_factory()`` returns ``client(prompts, n, instructions) -> list[dict(text,
    finish_reason)]`` with ``len(prompts) * n`` entries.  ``prompt_hash`` keys each result
    so a re-run task's duplicate calls can be reconciled downstream."""
    schema = T.StructType(df.schema.fields + [T.StructField("prompt_hash", T.StringType()),
                                              T.StructField(out_col, T.ArrayType(RESPONSE))])
    if instruction_col and prompt_batch_size != 1:
        raise ValueError("edits take one prompt at a time")
    pause = timeout if pause_after_batch is None else pause_after_batch
    ensure_library_on_workers(df.sparkSession)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = _cached(token, client_factory)
        for b in batches:
            # results leave the task as each prompt batch is answered
            for s in range(0, len(b), prompt_batch_size):
                part = b.iloc[s:s + prompt_batch_size].copy()
                prompts = list(part[prompt_col])
                instr = list(part[instruction_col]) if instruction_col else None
                part["prompt_hash"] = [hashlib.sha256((p or "").encode()).hexdigest() for p in prompts]
                part[out_col] = call_with_retry(client, prompts, n, instr, max_attempts=max_attempts, timeout=timeout,
                                                timeout_mf=timeout_mf, retry_when_blank=retry_when_blank, sleep=sleep)
                yield part
                if pause:
                    sleep(pause)
    return df.mapInPandas(run, schema)
