"""Token totals by source, language and tokenizer version, maintained by signed batches of changes.

A batch holds inserts (+1 document, its tokens), deletes (-1, minus its tokens) and revisions, which take the old count
back under its old keys and add the new one under the new keys. Totals are additive, so a batch shrinks to one signed row
per key before anything is written, and the totals are the sums over all committed batches.

*Commits.* ``deltas`` is partitioned by batch id; writing a batch replaces what a failed attempt left under the same id.
Then the id is added to ``commits``. Readers only count deltas of committed ids, each once, so a batch that is lost half
way doesn't show, and one that is sent again, also by a second writer, changes nothing.

Cases: null source, language or version are keys of their own. A null count counts as 0 tokens. Unknown operations are an
error, and so is an empty or missing batch id. An empty batch commits and changes nothing. Keys whose documents have all gone stay with 0 documents and 0 tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch_id string"
_COMMITS = "batch_id string"

# The split pattern of the public byte-level vocabulary
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Rollups:
    """The totals kept below ``path``, a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], _COMMITS).write.mode("append").parquet(f"{self.path}/commits")
        spark.createDataFrame([], _DELTAS).write.mode("append").partitionBy("batch_id").parquet(f"{self.path}/deltas")

    def committed(self) -> DataFrame:
        """Ids of the batches that count."""
        return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").distinct()

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes, unless its id is committed already; says whether it did. (job)

        ``changes`` has ``op`` (insert, delete or revise), and the keys and ``tokens`` of the document before and after:
        ``old_source, old_lang, old_tokenizer, old_tokens`` and ``source, lang, tokenizer, tokens``.
        """
        if not batch_id:
            raise ValueError("a batch needs an id")
        if not self.committed().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        delta = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).withColumn("batch_id", F.lit(batch_id))
        delta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.path}/deltas")
        self.spark.createDataFrame([(batch_id,)], _COMMITS).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches."""
        deltas = self.spark.read.schema(_DELTAS).option("recursiveFileLookup", "false").parquet(f"{self.path}/deltas")
        return deltas.join(self.committed(), "batch_id", "left_semi").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """One signed row for what each change adds, and one for what it takes back."""
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))))

    def side(prefix: str, sign: int):
        return F.struct(
            *(F.col(prefix + k).cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(F.col(prefix + "tokens"), F.lit(0))).cast("long").alias("tokens")
        )

    new, old = side("", 1), side("old_", -1)
    sides = F.when(known == "insert", F.array(new)).when(known == "delete", F.array(old)).otherwise(F.array(old, new))
    return changes.select(F.explode(sides).alias("s")).select("s.*")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_tokens``: tokens under a byte-level vocabulary of ranks. Null text has none.

    The driver reads the vocabulary (under 2 MB) and sends it along, so executors need no copy.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], [*kept, "_tokens"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "_tokens long"]))
