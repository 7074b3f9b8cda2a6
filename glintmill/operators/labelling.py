"""Labelling of pools by hand, a pool a screen; what is labelled is on disk at once, so it can be stopped and gone on with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.operators.judging import parsed_selection
from glintmill.sources import sinks
from glintmill.sources.tables import LABEL_SCHEMA

RULE = "=" * 78


def _screen(pool: list, question: str, answer: str | None, position: int, total: int) -> str:
    head = f"{RULE}\n{pool[0].question_id}: pool {position} of {total}, {len(pool)} candidates\n{RULE}\nQuestion: {question}\nAnswer: {answer}\n"
    return head + "".join(f"\n[{r.place}] {r.chunk_id}\n{r.text}\n" for r in pool) + f"\n{RULE}\nWhich are needed? Numbers, none, or q to stop."


def label_pools(pools: DataFrame, questions: DataFrame, path: str, only: str | None = None, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> int:
    """Shows each pool that has no label yet and appends its labels to the CSV folder ``path``; returns how many pools were labelled.

    ``pools`` (question_id, place, chunk_id, text), ``questions`` (question_id, question, gold_answer). An answer that can't be read is asked for again, a
    q stops. With ``only`` just that pool; one that is unknown or labelled raises. One pool at a time comes to the driver.
    """
    spark = pools.sparkSession
    ids = [r.question_id for r in pools.select("question_id").distinct().orderBy("question_id").collect()]  # as many as a person can label
    try:
        done = {r.question_id for r in spark.read.schema(LABEL_SCHEMA).csv(path, header=True).select("question_id").distinct().collect()}
    except Exception as e:  # nothing is there before the first label
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    if only is not None and (only not in ids or only in done):
        raise ValueError(f"{only}: " + ("already labelled" if only in done else "no such pool"))
    labelled = 0
    for question_id in [only] if only is not None else [i for i in ids if i not in done]:
        pool = pools.filter(F.col("question_id") == question_id).orderBy("place").collect()
        q = questions.filter(F.col("question_id") == question_id).first()
        say(_screen(pool, q.question, q.gold_answer, ids.index(question_id) + 1, len(ids)))
        while True:
            raw = ask(f"{question_id} > ")
            if raw.strip().lower() == "q":
                return labelled
            read = spark.range(1).select(parsed_selection(F.lit(raw), F.lit(len(pool))).alias("s")).first().s
            if read.error is None:
                break
            say(f"  {read.error}")
        rows = [(question_id, r.chunk_id, int(r.place in read.picked)) for r in pool]
        sinks.append_labels(spark.createDataFrame(rows, LABEL_SCHEMA).coalesce(1), path)
        labelled += 1
    return labelled
