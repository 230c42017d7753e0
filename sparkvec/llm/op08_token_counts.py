"""Token counts by a compiled finite-state transducer whose transitions carry the number of tokens they emit.

`transducer` compiles the tokenizer's pattern and merges into a deterministic transducer over characters. Every text, short or long, is cut
into chunks. A chunk is a map from the state before it to the state behind it and the tokens emitted; maps compose associatively,
and a prefix scan in pairs gives the map, so the count, of the whole text from the start state. Chunks are run from the
start state first; entered from another one, only the characters until both ways meet are run again. A text without any
white space is no special case.

Nulls and empty texts have 0 tokens and 0 bytes. Special strings are met in their own case, count 1, and are outside of all merges.
Repeated rows give repeated rows; an empty table gives an empty one. Other columns, whatever their names, are not read.
"""

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import by_bytes, texts
from sparkvec.llm.transducer import count_text, machine_of
from sparkvec.session import table

#: Characters of a chunk.
CHUNK = 1 << 16


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """key, n_bytes (UTF-8) and n_tokens of every whole text, without added special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for b in by_bytes(batches, "text"):
            n = [count_text(machine, t, chunk) for t in texts(b)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text), F.lit(""))
    src = df.select(F.col(key).cast("long").alias("key"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    return src.mapInArrow(run, "key long, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 2048 tokens) of all documents."""
    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
