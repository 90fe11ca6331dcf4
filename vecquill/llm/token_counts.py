"""Token counts by the whole-token shortcut.

Vocabulary strings are shown beforehand, with the library itself, to encode alone as one token; a pre-token that is
one of them counts as 1, and only the other pre-tokens are merged (see ``bytebpe``). Texts are read once, in one map
without a shuffle.

Defined results: a null text counts as empty (0 bytes, 0 tokens); any id, null or repeated, passes through; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.llm import bytebpe
from vecquill.llm.shared import batches_of, bounded_batches
from vecquill.llm.textbytes import slices, text_buffer


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row. vocabulary: path of a tokenizers .json file on every node."""
    bounded_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytebpe.table(vocabulary)
        for b in batches_of(it):
            data, offs = text_buffer(b.column(1))
            n = np.concatenate([table.tokenize(d, o, False)[0] for _, _, d, o in slices(data, offs)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n.astype(np.int64))], names=[id_col, "n_bytes", "n_tokens"])

    counted = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
