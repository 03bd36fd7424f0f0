"""Token counts: lengths only, from batched library calls inside Arrow functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import Segments, arrow_map, quoted


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``, by the tokenizers file at ``path``.

    Parts of a batch are balanced by bytes. Texts are split at safe boundaries (see Segments), so a
    very long text costs no more memory than its segments. Null and empty texts have 0 tokens; repeated
    rows and null ids give a row each; other columns are not read.
    """

    def run(batch: pa.RecordBatch):
        lengths = pa.compute.binary_length(batch["text"])
        n = [sum(map(len, v)) for v in Segments.load(path, True, True).of(batch["text"].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], lengths.cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            [id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(arrow_map(run, "text"), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
