"""Texts in Arrow batches of bounded size: the shape that most operators on single texts share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.shared import ship

#: Characters of text that are worked on at once, beside the one text that may exceed them.
CHARS = 4_000_000


def parts(texts: pa.Array, chars: int = CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Slices (start, texts) of an Arrow column with about `chars` characters each."""
    start, held, size = 0, [], 0
    for k, value in enumerate(texts):
        text = value.as_py()
        if held and size + len(text or "") > chars:
            yield start, held
            start, held, size = k, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    work: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    schema: str,
) -> DataFrame:
    """Columns `keep` of df, then those of `schema`, made from each text by the function work() gives.

    work() is called once in each task. Only the kept columns and the text are read. Any names
    may occur in df: columns travel under names of their positions, and a kept text but once.
    """
    ship(df.sparkSession)
    sent = [*keep, *([] if text in keep else [text])]
    at = sent.index(text)
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(sent)])
    fields = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(df.select(*[f"`{k}`" for k in keep]).schema)]
    made = [part.split(None, 1)[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for batch in batches:
            for start, texts in parts(batch.column(at)):
                kept = [batch.column(i).slice(start, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *do(texts)], names=[f"k{i}" for i in range(len(keep))] + made)
            pa.default_memory_pool().release_unused()  # workers live on, what they hold adds up

    out = rows.mapInArrow(run, ", ".join([*fields, schema]))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *made)
