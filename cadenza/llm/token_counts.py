"""Token counts by a map-side lookup of two tiers.

The first tier is a table of the token counts of the corpus's frequent pre-token runs, of a bounded
size, broadcast. It's made from all texts: each task keeps a lossy count of its runs, and only these
bounded summaries, never the runs' occurrences, are merged. The second tier is a cache in each
worker for runs that the table lacks. Counting itself has no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoders import load
from .runs import RunTable, odd, slices

#: Runs in the broadcast table, and in a task's summary.
FREQUENT = 16_384
SUMMARY = 16_384
#: Runs of more characters aren't kept: this bounds the table's bytes.
LONGEST = 32


def frequent_runs(docs: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(run, n) of about the most frequent runs of all texts, ``most`` at the most.

    A task drops its rarest runs when it holds too many (a lossy count), so n can be too low, and runs as
    frequent as the first that there's no place for are left out; the table decides on speed alone, never on a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for texts in slices(batch.column(0).drop_null()):
                found = pc.value_counts(pc.split_pattern(texts, " ").flatten())
                often = found.filter(pc.greater(found.field("counts"), 1))
                held.update(dict(zip(often.field("values").to_pylist(), often.field("counts").to_pylist())))
                if len(held) > 8 * SUMMARY:
                    held = Counter(dict(held.most_common(2 * SUMMARY)))
        top = [(k, n) for k, n in held.most_common(SUMMARY) if len(k) <= LONGEST and not odd(k)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["run", "n"])

    summaries = docs.select("text").mapInArrow(run, "run string, n bigint")
    summed = common.saved(summaries.groupBy("run").agg(F.sum("n").alias("n")), "runs")
    # A histogram of n tells where to cut, so no more than ``most`` runs come to the driver from however many partitions.
    level = F.floor(F.log2("n") * 16)
    room, least = most, None
    for row in summed.groupBy(level.alias("level")).agg(F.count("*").alias("runs")).orderBy(F.desc("level")).collect():  # at most 16 * 64 rows
        if row.runs > room:
            break
        room, least = room - row.runs, row.level
    return summed.where(level >= least if least is not None else F.lit(False))


def _lengths(ends: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def _tools(tokenizer: str, shared: Broadcast) -> tuple:
    """Encoder and table of runs of a worker, kept for its next task."""
    encoder = load(tokenizer)
    return encoder, RunTable(encoder.runs, encoder.each, hot=shared.value)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row for each row of docs (doc_id, text).

    Tokens are counted without begin, end or added special tokens, over whole texts. A null text
    counts as an empty one: no bytes, no tokens. doc_id may be null or repeated; an empty table gives no
    rows; other columns aren't looked at.
    """
    spark = docs.sparkSession
    encoder = load(tokenizer)
    base: dict[str, int] = {}
    if encoder.by_runs and frequent:
        runs = [r.run for r in frequent_runs(docs, frequent).collect()]  # FREQUENT rows of LONGEST characters at the most
        base = dict(zip(runs, _lengths(encoder.runs(runs, True)[1])))
    shared = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _tools(tokenizer, shared)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            counts = table.counts(texts) if encoder.by_runs else np.array([len(encoder.whole([x])[0]) for x in texts.to_pylist()], np.int64)
            arrays = [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text of documents under byte_bpe_50k.json, against a limit of 512."""
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
