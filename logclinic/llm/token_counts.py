"""Token counts: pieces counted once per distinct pre-token, joined to the texts' pre-token frequencies, and summed.

The join stays inside a block of texts: the distinct pre-tokens of a block meet the frequencies of the same block as
arrays.  Nothing is shuffled, so no pre-token can become a hot key, and token ids are never built.

Null texts count as empty; rows with equal ids are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks
from logclinic.llm.staging import prepare
from logclinic.llm.tokens import per_text, tokenizer_of


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row; `path`: a byte-level BPE file of the tokenizers library."""
    prepare(docs.sparkSession)

    def count(batches):
        tokenizer = tokenizer_of(path)
        for block in blocks(batches):
            texts = pc.fill_null(block.column("text"), "")
            codes, n_units, units = tokenizer.units(texts)
            pre_codes, n_pre, pre_tokens = tokenizer.pre_tokens(units)
            pieces = tokenizer.counts(pre_tokens)
            of_unit = per_text(pieces[pre_codes], n_pre)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(per_text(of_unit[codes], n_units), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
