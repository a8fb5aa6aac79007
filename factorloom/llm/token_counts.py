"""Token counts by rank-synchronous merging (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import ddl, fresh, need
from .textarrays import utf8

TOKENIZER = "byte_bpe_50k.json"


def default_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``df``: the ``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    A null or empty text has 0 bytes and 0 tokens. Texts are counted whole, however long. Repeated rows stay repeated,
    other columns (of whatever name) are ignored, an empty table gives an empty result. No shuffle: a narrow map.
    """
    need(df, [text, *keep])
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            column = batch.column(len(keep))
            _, off = utf8(column)
            counts = [c for _, _, c, _ in vocab.encode(column, ids=False)]
            n = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    out = ddl(df, keep, "n_bytes long, n_tokens long, over_limit boolean")
    return df.select(*keep, F.col(text).alias(fresh(df, "_text_"))).mapInArrow(run, out)
