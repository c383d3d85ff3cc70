"""Operator 4, token counts: whole-token shortcut.

Offline, once in each Python worker, it is proved which vocabulary strings are a single token when they stand alone
as a pre-token. Pre-tokens that are such strings count as one without any merging; only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .tokens import counter


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """Adds `out`, the number of tokens of each whole text; a null or empty text has 0.

    `tokenizer` is the path of a byte-level BPE for the tokenizers library, `pattern` the expression that splits its
    pre-tokens. Strings of special tokens inside a text count as the library counts them by default. One narrow pass:
    no shuffle, rows stay where they are read, whatever their order, number or repetitions. `keep`: the columns that
    go along (all but the text, unless given); a column of the name `out` is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out and (keep is not None or c != text)]
    rows = docs.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, pattern)
        for b in slices(batches):
            n = [count(x) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n, pa.int64())], [*kept, out])

    return rows.mapInArrow(run, schema)
