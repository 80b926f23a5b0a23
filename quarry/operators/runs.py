"""Runs of an extraction model over chunks: bounded retries, failures as rows, and a next run that takes up what is left.

A run is one map that writes answers and failures in one pass, so nothing is asked twice: `ok=true` and `ok=false` under a
folder of the run.  What is answered is never asked again; what failed is, by the next run.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.changes import pending
from quarry.operators.models import Extractor

# fixed values: tries of a call, seconds of the first pause (each later one is longer by as much), and how much of a
# failed answer is kept
TRIES, PAUSE, CLIP = 3, 1.5, 10_000

_RESULT = "response string, error string, tries int"


class Rejected(Exception):
    """Raised by an extractor or a check for an answer that can't be used; `response` is kept with the failure."""

    def __init__(self, message: str, response: str | None = None):
        super().__init__(message)
        self.response = response


def _asked(extractor: Extractor, texts: Sequence[str], tries: int, pause: float) -> tuple[list[str] | None, str | None, str | None, int]:
    """Answers to some texts, or the last error and the answer that it rejects; and how often was tried."""
    error, rejected = None, None
    for k in range(1, tries + 1):
        try:
            answers = list(extractor(texts))
            if len(answers) != len(texts):
                raise Rejected(f"{len(answers)} answers to {len(texts)} texts")
            return answers, None, None, k
        except Exception as problem:  # noqa: BLE001  a failed call is a row, not a failed job
            error, rejected = f"{type(problem).__name__}: {problem}", getattr(problem, "response", None)
            if k < tries:
                time.sleep(pause * k)
    return None, error, rejected, tries


def attempts(chunks: DataFrame, extractor: Extractor, batch: int = 16, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """Asks for every chunk (chunk_id, text and more): the chunk's columns but text, response, error, tries, ok.

    Texts go to the extractor in batches; a batch that keeps failing is asked text by text, so one bad text doesn't take
    others with it.  Null texts are asked as empty ones.  Responses of failures are cut to CLIP characters.
    """
    kept = [f for f in chunks.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _RESULT])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), batch):
                part = frame.iloc[begin : begin + batch]
                texts = part["text"].fillna("").tolist()
                answers, error, rejected, used = _asked(extractor, texts, tries, pause)
                if answers is not None:
                    rows = [(a, None, used) for a in answers]
                elif len(texts) == 1:
                    rows = [(rejected, error, used)]
                else:
                    rows = []
                    for text in texts:
                        one, error, rejected, used = _asked(extractor, [text], tries, pause)
                        rows.append((one[0], None, used) if one is not None else (rejected, error, used))
                told = pd.DataFrame(rows, columns=["response", "error", "tries"], index=part.index)
                yield pd.concat([part.drop(columns="text"), told], axis=1)

    given = chunks.select(*(f.name for f in kept), F.col("text").cast("string").alias("text"))
    done = given.mapInPandas(ask, schema)
    ok = F.col("error").isNull()
    return done.withColumn("ok", ok).withColumn("response", F.when(ok, F.col("response")).otherwise(F.substring("response", 1, CLIP)))


def extraction_run(chunks: DataFrame, extractor: Extractor, folder: str, run: int, unusable: Column | None = None, **options: float) -> dict[str, int]:
    """Asks for the chunks that no earlier run has answered, writes what comes, and counts it: asked, answered, failed.

    run numbers the runs of a folder; a run of a number that was cut off is written anew.  `unusable` is an error message
    over the columns of `attempts` for answers that can't be used (such as JSON that doesn't parse), else null.
    """
    spark = chunks.sparkSession
    left = pending(chunks, answers(spark, folder).select("chunk_id"), "chunk_id") if run > 1 else chunks
    told = attempts(left, extractor, **options)
    if unusable is not None:
        told = told.withColumn("error", F.coalesce("error", unusable)).withColumn("ok", F.col("error").isNull())
        told = told.withColumn("response", F.when(F.col("ok"), F.col("response")).otherwise(F.substring("response", 1, CLIP)))
    from pyspark.sql import Observation

    seen = Observation()
    counted = told.observe(seen, F.count("*").alias("asked"), F.count_if("ok").alias("answered"), F.count_if(~F.col("ok")).alias("failed"))
    counted.write.mode("overwrite").partitionBy("ok").parquet(f"{folder}/run={run:06d}")
    return {k: int(v or 0) for k, v in seen.get.items()}


def _written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("basePath", folder).parquet(f"{folder}/run=*").withColumn("ok", F.col("ok").cast("boolean"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """What all runs have answered."""
    return _written(spark, folder).where("ok").drop("ok", "error")


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """The last failure of each chunk that no run has answered."""
    rows = _written(spark, folder)
    last = rows.where("NOT ok").groupBy("chunk_id").agg(F.max("run").alias("run"))
    return rows.where("NOT ok").join(last, ["chunk_id", "run"]).join(rows.where("ok").select("chunk_id"), "chunk_id", "left_anti").drop("ok")
