"""Token counts of whole texts by rank-synchronous merging."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.merging import encoder_of
from tidemark.llm.vocab import default_path, read_json_bpe
from tidemark.session import ship


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """Per row its id, UTF-8 bytes, tokens, and whether these exceed ``limit``.

    One narrow pass without a shuffle; only the two columns are read, so
    others may have any name. The vocabulary file (``vocabulary``: a path, by
    default the 50k byte-level one) is read on the driver and sent along; its
    size does not depend on the data. A null text counts as empty: 0 bytes, 0
    tokens. A null id stays null; repeated rows each give a row; an empty
    table gives an empty result. Special strings inside a text count as the
    one token they are to the library.
    """
    import public_tokenizers

    ship(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(read_json_bpe(vocabulary or default_path("byte_bpe_50k.json")))
    pattern = public_tokenizers.PATTERN

    def count(batches):
        encoder = encoder_of(spec.value, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            n = pa.array(encoder.counts(texts.to_pylist()), pa.int64())
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
