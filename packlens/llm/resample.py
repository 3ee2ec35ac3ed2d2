"""Importance resampling of documents towards a target collection.

Features (runs of words) are counted in hash buckets, over the corpus and over the
target. Each bucket has an integer gain, and a document's weight is the mean gain of
its features, looked up in one array. Integer noise that depends on doc_id only
turns the weights into scores, of which the highest are drawn: a histogram of the
scores, summed from the top, gives each score the rank that its first document has,
and rows are numbered by doc_id inside the scores that survive. Nothing is sorted
as a whole, and no text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, texts

#: What a byte of text becomes: letters a-z, digits and all bytes of longer characters stay, A-Z are lower-cased, the rest parts words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: A bucket of the score histogram's blocks: so many scores are summed by one row.
SCORE_BLOCK = 1024


@dataclass(frozen=True)
class Features:
    """Runs of ``low`` to ``high`` consecutive words, counted in ``buckets`` hash buckets."""

    low: int = 1
    high: int = 1
    buckets: int = 10_000

    def of(self, piece: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets of all features of the texts of a piece, one text after another; features and words by text."""
        crc = Checksums()
        found, n_words, n_features = [], [], []
        for text in piece:
            words = text.translate(WORD_BYTES).split()
            sums = np.fromiter(map(crc.__getitem__, words), np.int64, len(words))
            count = 0
            for n in range(1, min(self.high, len(words)) + 1):
                if n > 1:  # the checksum of a run goes on from that of the run without its last word
                    sums = np.array([zlib.crc32(b" " + w, c) for c, w in zip(sums[:-1].tolist(), words[n - 1 :], strict=True)], np.int64)
                if n >= self.low:
                    found.append(sums % self.buckets)
                    count += len(sums)
            n_words.append(len(words))
            n_features.append(count)
        return np.concatenate(found) if found else np.empty(0, np.int64), np.array(n_features, np.int64), np.array(n_words, np.int64)


class Checksums(dict):
    """CRC-32 by word; each is worked out once a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = zlib.crc32(word)
        return found


def bucket_counts(docs: DataFrame, features: Features = Features()) -> DataFrame:
    """``bucket, n``: how many features of all ``docs(text)`` each bucket holds (buckets without any don't appear).

    A task adds up its own texts first, so at most ``buckets`` rows a task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                held += np.bincount(features.of(texts(part.column("text")))[0], minlength=features.buckets)
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, features: Features = Features()) -> np.ndarray:
    """The gain of each bucket: ``floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets))))``.

    ``corpus`` and ``target`` are bucket counts; what reaches the driver is one row a
    bucket, a number that is a parameter.
    """
    counts = []
    for table in (corpus, target):
        held = np.zeros(features.buckets)
        for row in table.collect():
            held[row.bucket] = row.n
        counts.append(held)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + features.buckets) / ((s + 1) * (t.sum() + features.buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, features: Features = Features()) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row of ``docs(doc_id, text)``; the array of gains goes along with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, n, words = features.of(texts(part.column("text")))
                sums = np.append(0, np.cumsum(gain[found]))
                ends = np.cumsum(n)
                weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Integer Gumbel noise of thousandths, by doc_id and ``seed`` only."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((first + 0.5) / F.lit(4294967296.0)))).cast("long")


def score_offsets(rows: DataFrame) -> DataFrame:
    """``score, n, above``: how many of ``rows(score)`` have each score, and how many a higher one.

    Scores are integers between bounds that the gains and the noise set, so the
    histogram has some ten thousand rows whatever the corpus. It is summed from the
    top in blocks: inside each block of scores, and over the blocks.
    """
    histogram = rows.groupBy("score").agg(F.count("*").alias("n")).withColumn("_block", F.floor(F.col("score") / SCORE_BLOCK))
    histogram = materialize(histogram, "score-histogram")
    blocks = histogram.groupBy("_block").agg(F.sum("n").alias("held"))
    higher = blocks.select("_block", (F.sum("held").over(Window.orderBy(F.col("_block").desc())) - F.col("held")).alias("before"))  # one row a block of scores
    inside = F.sum("n").over(Window.partitionBy("_block").orderBy(F.col("score").desc())) - F.col("n")
    return histogram.join(higher, "_block").select("score", "n", (F.col("before") + inside).alias("above"))


def resample(docs: DataFrame, target: DataFrame, features: Features = Features(), percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw the documents that are most like ``target``: doc_id, n_features, weight, score, rank of every row of ``docs``.

    ``docs`` has doc_id and text, ``target`` text; other columns are ignored. Of the
    documents with at least ``min_words`` words, ``floor(percent * N / 100)`` are drawn:
    those of highest score, ties to the smaller doc_id (a null doc_id first). ``rank``
    counts them from 1; it is null for all others. Null, empty and wordless texts have
    no features and weight 0. Rows that repeat a doc_id are scored each on its own and have
    ranks of their own. An empty table gives no rows; an empty target leaves every
    bucket its smoothed gain.
    """
    gain = gains(bucket_counts(docs, features), bucket_counts(target, features), features)
    scored = weighted(docs, gain, features).withColumn("score", F.col("weight") + noise(seed)).withColumn("_place", F.spark_partition_id())
    scored = materialize(scored, "resample-scores")
    able = scored.where(F.col("n_words") >= min_words)
    offsets = materialize(score_offsets(able), "score-offsets")
    drawn = (offsets.agg(F.sum("n")).first()[0] or 0) * percent // 100
    cutoff = offsets.where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    taken = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(cutoff)) if cutoff is not None else F.lit(False)
    ranked = ranks(scored.where(taken), offsets.where(F.col("above") < drawn)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("long")).select(*names))


def ranks(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: numbered inside each score by doc_id from the score's offset on.

    Scores depend on doc_id, so rows that repeat one share a score. They are counted by
    (score, doc_id, place where they were written) first; rows are numbered within such
    a group, which is never larger than what one task wrote.
    """
    keys = ["score", "doc_id", "_place"]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = groups.withColumn("_start", F.sum("_n").over(Window.partitionBy("score").orderBy("doc_id", "_place")) - F.col("_n"))
    starts = starts.join(F.broadcast(offsets.select("score", "above")), "score")  # a row a score: bounded, see score_offsets
    same = (F.col("r.score") == F.col("s.score")) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r._place") == F.col("s._place"))
    joined = rows.alias("r").join(starts.alias("s"), same).select("r.*", "s._start", "s.above")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "n_features"))
    return joined.withColumn("rank", F.col("above") + F.col("_start") + number)


def resample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resample`` of all documents towards the benchmark texts; its docstring states what null, empty and repeated rows give."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
