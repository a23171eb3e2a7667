"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Where the vocabulary is: ranks of a byte-level BPE, one "token rank" a line.
VOCABULARY = os.environ.get("QUADFLOW_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary's texts are parted before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(vocabulary: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file, read once per process."""
    if vocabulary not in _encodings:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def with_tokens(rows: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with n_tokens in place of the text column; a null or empty text has 0 tokens, a column n_tokens is replaced.

    An executor that does not have the vocabulary's file where the driver has it gets it from the driver."""
    rows.sparkSession.sparkContext.addFile(vocabulary)
    fields = [f for f in rows.schema.fields if f.name.lower() not in (text.lower(), "n_tokens")]
    kept = [f.name for f in fields]
    schema = StructType([*fields, StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
        encode = encoding(here).encode_ordinary
        for b in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in b.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], counts], names=[*kept, "n_tokens"])

    return rows.select(*kept, text).mapInArrow(run, schema)
