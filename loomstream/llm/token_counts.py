"""Token counts by compiled finite-state transducers (see bpe_fst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_fst import default_tokenizer_path, transducer
from .common import buffers, select_as, slices


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizer_path: str | None = None) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); null ids are returned as they are; repeated rows each give a row;
    an empty table gives no rows; further columns of docs are ignored.  A narrow map over the scan: nothing is
    shuffled, and a worker holds one Arrow batch and the compiled transducer.
    """
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            counts = [machine.count(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]) for i, j in slices(offsets)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = select_as(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
