"""MinHash near-dedup: banded MinHash candidates, odd-sketch estimates, exact confirmation on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.prefilter import semi_join
from tessera.llm.set_linking import link_sets
from tessera.plans.scratch import Scratch

WORDS = 5
ROWS, BANDS = 6, 64
SKETCH_BITS = 1024
#: Pairs below this estimate are not confirmed; 4.5 standard deviations of the estimate below the threshold of 0.75.
LEAST_ESTIMATE = 0.60
CACHE_WORDS = 150_000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_MULT = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


class _WordHash(dict):
    """64-bit hash by word, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, cache: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    n = len(words)
    if not n:
        return np.empty(0, dtype=_U)
    w = np.fromiter(map(cache.__getitem__, words), dtype=_U, count=n)
    if n < WORDS:
        h = np.array([n], dtype=_U)
        for i in range(n):
            h = _mix(h * _STEP[0] + w[i])
        return h
    h = w[: n - 4] * _STEP[0]
    for i in range(1, WORDS):
        h = _mix(h + w[i : n - 4 + i]) * _STEP[i]
    return np.unique(_mix(h))


def minhash(sh: np.ndarray) -> np.ndarray:
    """The ROWS * BANDS smallest hashes of a non-empty set."""
    x = (sh >> _U(32)).astype(np.uint32)
    out = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * _MULT[None, :]).min(axis=0), out=out)
    return out


def bands(mh: np.ndarray) -> np.ndarray:
    m = mh.reshape(BANDS, ROWS).astype(_U)
    h = np.arange(1, BANDS + 1, dtype=_U) * _STEP[0]
    for i in range(ROWS):
        h = _mix(h + m[:, i] * _STEP[1])
    return h.view(np.int64)


def odd_sketch(mh: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash samples, as 64-bit words: a sample flips one bit, so common samples cancel in XOR."""
    at = _mix(mh.astype(_U) + (np.arange(len(mh), dtype=_U) << _U(32))) % _U(SKETCH_BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """XOR population count that the expected sketch pair of this similarity has."""
    flips = 2 * ROWS * BANDS * (1 - similarity)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _WordHash()
    for batch in batches:
        texts, n, sig, keys, sketch = batch.column(2), [], [], [], []
        for value in texts:
            sh = shingles(value.as_py(), cache)
            n.append(len(sh))
            if not len(sh):
                sig.append(None), keys.append(None), sketch.append(None)
                continue
            mh = minhash(sh)
            sig.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest())
            keys.append(bands(mh)), sketch.append(odd_sketch(mh))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, longs), pa.array(sketch, longs)],
            names=["row", "doc_id", "n_shingles", "sig", "bands", "sketch"],
        )


def _confirm(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for batch in batches:
            keep, last, last_sh = [], None, None
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                ta, tb = a.as_py(), b.as_py()
                if ta != last:
                    last, last_sh = ta, shingles(ta, cache)
                sb = shingles(tb, cache)
                union = len(np.union1d(last_sh, sb))
                inter = len(last_sh) + len(sb) - union
                keep.append(union > 0 and 100 * inter >= threshold_pct * union)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the sets of both texts and the shingles that only one of them has."""
    cache = _WordHash()
    for batch in batches:
        n_a, n_b, apart, last, last_sh = [], [], [], None, None
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            ta = a.as_py()
            if ta != last:
                last, last_sh = ta, shingles(ta, cache)
            sb = shingles(b.as_py(), cache)
            n_a.append(len(last_sh)), n_b.append(len(sb))
            apart.append(np.setxor1d(last_sh, sb, assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(apart, pa.list_(pa.int64()))],
            names=["c", "id", "n_c", "n", "d"],
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. See ``linked_rows``."""
    return linked_rows(docs, id_col, text_col, threshold_pct).drop("row")


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = 75) -> DataFrame:
    """One row per document: row (a hash of id and text), doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= threshold_pct * |A | B| over their sets of five-word shingles (words are
    runs other than ASCII white space, A-Z lower-cased). Documents of equal sets form a class by a 128-bit digest; one
    of a class stands for it. Candidates share one of 64 bands of 6 MinHashes (a pair at 0.75 is missed with
    probability 4e-6) and pass the odd-sketch estimate; each is confirmed on the full sets of both texts. Of a bucket of
    many, set_linking finds the pairs without comparing all members.

    Null and empty texts have no shingles and are linked with nothing. A null doc_id gets a null component_id and is
    kept. Rows that repeat both id and text give equal rows; an id with several texts counts as several documents,
    whose component is the smallest id among them all the same. Further columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    own = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(own.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(
        rows.mapInArrow(_signatures, "row long, doc_id long, n_shingles long, sig binary, bands array<long>, sketch array<long>"), "signed"
    )
    some = signed.where("sig IS NOT NULL")
    classes = some.groupBy("sig").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"))
    classes = scratch.save(classes, "classes")
    reps = some.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").dropDuplicates(["row"])
    reps = scratch.save(reps.select(F.col("row").alias("id"), "bands", "sketch"), "reps")
    slim = scratch.save(signed.select("row", "doc_id", "n_shingles", "sig"), "sizes")
    scratch.drop(signed)
    scratch.sweep()
    buckets = reps.select(F.explode(F.array_distinct("bands")).alias("key"), "id")

    def passing(pairs: DataFrame) -> DataFrame:
        left = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
        right = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
        odd = F.lit(0)
        for i in range(SKETCH_BITS // 64):
            odd = odd + F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i))))
        return pairs.join(left, "a").join(right, "b").where(odd <= most_odd_bits(LEAST_ESTIMATE)).select("a", "b")

    def with_texts(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs, "to-read")
        wanted = scratch.save(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "wanted")
        texts = scratch.save(semi_join(rows.select("row", "text"), wanted, "row").dropDuplicates(["row"]), "texts")
        ta = texts.select(F.col("row").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
        return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")

    def confirm(pairs: DataFrame) -> DataFrame:
        return with_texts(pairs).mapInArrow(_confirm(threshold_pct), "a long, b long")

    def differences(pairs: DataFrame) -> DataFrame:
        read = with_texts(pairs.select(F.col("c").alias("a"), F.col("id").alias("b")))
        return read.mapInArrow(_differences, "c long, id long, n_c long, n long, d array<long>")

    labels = link_sets(scratch, buckets, passing, confirm, differences, threshold_pct)
    # Components by class, then the smallest doc_id of all members.
    roots = classes.join(labels.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    by_sig = roots.join(lowest, "root").select("sig", "component_id")
    out = slim.join(by_sig, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("row", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = scratch.save(out, "result")
    scratch.keep(out)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that a smaller id of their group stands for; all columns stay. Of an id with several texts each
    is judged on its own; rows that repeat id and text stay or go together."""
    gone = linked_rows(docs, id_col, text_col).where(~F.col("kept")).select(F.col("row").alias("__gone")).distinct()
    own = docs.withColumn("__own", F.xxhash64(F.col(id_col), F.col(text_col)))
    return own.join(gone, own["__own"] == gone["__gone"], "left_anti").drop("__own")
