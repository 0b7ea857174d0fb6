"""Token counts of whole texts by the compiled word-level BPE transducer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .wordbpe import compiled


def count_tokens(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: (id_col, n_bytes, n_tokens, over_limit).

    Counts are those of the tokenizers library for the file ``vocab`` without
    added tokens; special strings inside a text count as their one token. A
    null text counts as empty: 0 bytes, 0 tokens. One pass, no shuffle. Rows
    repeat as in docs; ids may be null; other columns are not read.
    """

    def run(cols: list[list]) -> list:
        n = compiled(vocab).count(cols[1])
        return [cols[0], [len((t or "").encode("utf-8", "surrogatepass")) for t in cols[1]], n, [x > limit for x in n]]

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "id long, n_bytes long, n_tokens long, over_limit boolean", run).withColumnRenamed("id", id_col)
