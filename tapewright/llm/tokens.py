"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Byte-level BPE: every text has a size. Any tokenizer file of the same library can be named instead.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_BATCH_CHARS = 2_000_000


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def sizes(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; NULL and empty texts have none."""
    t = load(path)
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    out: list[int] = []
    batch: list[str] = []
    held = 0
    for x in [*texts, None]:
        if batch and (held > _BATCH_CHARS or len(out) + len(batch) == len(texts)):
            out.extend(len(e.ids) for e in encode(batch, add_special_tokens=False))
            batch, held = [], 0
        if len(out) + len(batch) < len(texts):
            batch.append(x or "")
            held += len(x or "")
    return out


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens`` of every row; whole texts, without cutting."""
    plain = documents.select(*keep, F.col(text).alias("__text"))
    schema = StructType([*[StructField(f.name, f.dataType) for f in plain.schema.fields[:-1]], StructField("tokens", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sizes(b.column(n).to_pylist(), tokenizer), pa.int64())], schema=arrow)

    return plain.mapInArrow(run, schema)
