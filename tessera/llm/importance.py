"""Importance resampling towards a target: hashed n-gram buckets of raw texts and of the target, gains, and a Gumbel draw.

Words are found and hashed in the bytes of Arrow's UTF-8 buffers by array operations alone: a table of 256 entries says what each
byte is (lower case, or no part of a word), differences of neighbouring bytes give the words' starts and ends, and the
table-driven CRC-32 goes on one byte for all starts at once. Longer n-grams go on from the CRC of the shorter ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.places import numbered
from tessera.plans.scratch import Scratch

#: Words in a feature at most, buckets, seed of the draw, words of a document that may be drawn, per cent of them drawn.
NGRAM, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of texts handled at once, and bytes of a word up to which all words go on together; a longer one is hashed on its own.
BLOCK, TOGETHER = 4 << 20, 48


def _byte_table() -> np.ndarray:
    """What a byte is in a word: itself, the lower-case letter, or 0 outside of words."""
    out = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[low : high + 1] = np.arange(low, high + 1)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_BYTES, _CRC = _byte_table(), _crc_table()


def _go_on(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after data[start : start + size] of each."""
    crc = crc.copy()
    short = np.flatnonzero(sizes <= TOGETHER)
    order = short[np.argsort(-sizes[short], kind="stable")]
    state, at, left = crc[order], starts[order], sizes[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # those with more than k bytes come first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    crc[order] = state
    for i in np.flatnonzero(sizes > TOGETHER):
        s = int(starts[i])
        crc[i] = zlib.crc32(data[s : s + int(sizes[i])].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return crc


def features(data: np.ndarray, ends: np.ndarray, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in ``data`` one behind the other and end at ``ends``: words of each text, and text and CRC-32 of every
    feature, a run of up to ``ngram`` words joined by one space."""
    low = _BYTES[data]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = low != 0
    turns = np.diff(inside, prepend=np.int8(0))
    is_start, is_end = turns == 1, turns == -1
    inner = ends[(ends > 0) & (ends < len(data))]  # where a text ends, a word does, even if the next text goes on with one
    cut = np.unique(inner[(inside[inner - 1] == 1) & (inside[inner] == 1)])
    is_start[cut] = is_end[cut] = True
    starts, stops = np.flatnonzero(is_start), np.flatnonzero(is_end)
    text = np.searchsorted(ends, starts, side="right")
    words = np.bincount(text, minlength=len(ends))
    crc = _go_on(np.full(len(starts), 0xFFFFFFFF, np.uint32), low, starts, stops - starts)
    texts, hashes = [text], [crc ^ np.uint32(0xFFFFFFFF)]
    first = np.arange(len(starts))
    for n in range(1, ngram):
        going = first[first + n < len(starts)]
        going = going[text[going] == text[going + n]]
        if not len(going):
            break
        state = _CRC[(crc[going] ^ np.uint32(0x20)) & 255] ^ (crc[going] >> 8)
        crc = crc.copy()
        crc[going] = _go_on(state, low, starts[going + n], (stops - starts)[going + n])
        first = going
        texts.append(text[going]), hashes.append(crc[going] ^ np.uint32(0xFFFFFFFF))
    return words, np.concatenate(texts), np.concatenate(hashes)


def _blocks(column: pa.Array):
    """(first row, bytes, ends) of the rows of a string column, about BLOCK bytes at a time, one row at least; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row + 1 : end + 1] - offsets[row]
        row = end


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of the texts; a task adds its counts up first and sends one row a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, ends in _blocks(batch.column(0)):
                total += np.bincount(features(data, ends, ngram)[2] % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of both tables' counts
    s and t, which add up to S and T. Both arguments are (bucket, n)."""
    s, t = raw.toDF("bucket", "s"), target.toDF("bucket", "t")
    all_s, all_t = (float(x.agg(F.sum(x.columns[1])).first()[0] or 0) for x in (s, t))
    every = spark.range(buckets).toDF("bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    ratio = (F.col("t").cast("double") + 1) * F.lit(all_s + buckets) / ((F.col("s").cast("double") + 1) * F.lit(all_t + buckets))
    return every.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: list[int], ngram: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; ``gain`` is the list of all buckets' gains."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = np.array(gain, np.int64)

    def weigh(batches):
        for batch in batches:
            parts = []
            for _, data, ends in _blocks(batch.column(1)):
                words, text, crc = features(data, ends, ngram)
                weight = np.zeros(len(ends), np.int64)
                np.add.at(weight, text, table[crc % len(table)])
                parts.append((words, np.bincount(text, minlength=len(ends)), weight))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, scratch: Scratch, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """weighed(doc_id, n_words, n_features, weight) plus score and rank; rank is null for what is not drawn.

    The noise depends on the id alone, so rows that share an id share it. The places of the scores come from sorted ranges,
    not from one task.
    """
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = scratch.save(weighed.withColumn("score", F.col("weight") + noise), "scored")
    may = F.col("n_words") >= least_words
    n = scored.where(may).count()
    placed = numbered(scratch, scored.where(may), [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features"], name="rank")
    rank = F.when(F.col("rank") < percent * n // 100, F.col("rank") + 1)
    return placed.withColumn("rank", rank).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, **options) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text), drawn towards target(text).

    Null and empty texts have no features and weight 0; they are scored and, as short ones, not drawn. Null ids are scored
    as an empty id and come first among equal scores. Rows that repeat id and text are ranked one after the other. Empty
    tables: no rows of docs give none, no target gives every bucket the target count 0. Other columns are passed over.
    The only thing that passes the driver is the list of gains, one number a bucket.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    raw, goal = (scratch.save(bucket_counts(x, ngram=ngram, buckets=buckets), "counts") for x in (docs, target))
    gain = [x[1] for x in sorted(gains(spark, raw, goal, buckets).collect())]
    out = draw(weights(docs, gain, ngram), scratch, **options)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
