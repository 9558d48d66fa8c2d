"""Problem 8: encoding of a corpus by a public tokenizer, and token counts for the operators that need sizes only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.bpe import DEFAULT_FOLDER, encoder
from codelens.sources.checkpoints import spread


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(key, ids): the token ids of each row's text.

    Null and empty texts give the empty list; special-token strings are ordinary text; repeated rows stay repeated; other
    columns of `df` are not read. One pass over Arrow batches, no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer, folder)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends, flat = [0], pa.array([], pa.int32())
            for x in ids:
                ends.append(ends[-1] + len(x))
            if ends[-1]:
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(x.tobytes() for x in ids))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", name: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The columns `keep` and the number of tokens of each row's text (0 for null and empty)."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = encoder(tokenizer, folder)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, name])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, f"{schema}, {name} bigint")
