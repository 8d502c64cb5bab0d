"""Answers of an external model beside rows, with a deterministic fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A client takes a prompt and returns the answer's text, or None.
Client = Callable[[str], str | None]


def answered(df: DataFrame, prompt: Column, make_client: Callable[[], Client] | None, attempts: int = 1) -> DataFrame:
    """Adds ``answer``: what the client says to each row's prompt.

    ``make_client`` is called once per task, on the executor, so a client may hold a
    connection. A null prompt isn't sent. A call that raises is tried ``attempts``
    times in all, then the answer is null, as it is without a client; one bad row
    doesn't end the job. Filter before this: every row that is left is sent.
    """
    if make_client is None:
        return df.withColumn("answer", F.lit(None).cast("string"))
    asked = df.withColumn("answer", prompt.cast("string"))

    def ask(client: Client, text: str | None) -> str | None:
        for _ in range(attempts if text is not None else 0):
            try:
                return client(text)
            except Exception:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            texts = b["answer"].astype(object).where(b["answer"].notna(), None)
            yield b.assign(answer=[ask(client, t) for t in texts])

    return asked.mapInPandas(run, StructType([*df.schema.fields, StructField("answer", StringType())]))


def sentence(answer: Column, fallback: Column) -> Column:
    """A trimmed answer, or the fallback where there is none."""
    said = F.trim(answer)
    return F.when(F.length(said) > 0, said).otherwise(fallback)
