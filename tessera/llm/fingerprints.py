"""Document fingerprints: quartile codes of hashed byte-triplet counts and a length code, with a bounded difference."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512
LENGTH_STEP = 1.15
#: Difference score: code steps 0, 1, 2, 3 cost 0, 1, 2, 6; the length code costs its steps, at most LENGTH_MOST.
COST = np.array([0, 1, 2, 6])
LENGTH_MOST = 40
#: Mean cost of a bucket at which the likeness is 0.
ZERO_AT = 2.0


def counts(data: bytes) -> np.ndarray:
    """Counts of the buckets that the triplets (a b c), (a b d), (a c d) of every window of four bytes hash to."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.int64)
    step = 1 << 20
    for i in range(0, max(len(b) - 2, 0), step):
        x = b[i : i + step + 3]
        n = len(x)
        for salt, (p, q, r) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
            m = min(n - r, step)
            if m <= 0:
                continue
            h = (x[p : p + m] << np.uint32(16)) | (x[q : q + m] << np.uint32(8)) | x[r : r + m]
            h = (h + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            out += np.bincount(h >> np.uint32(23), minlength=BUCKETS)
    return out


def fingerprint(text: str | None) -> str:
    """Hex digest: two digits of length code, then two bits a bucket: above how many quartiles its count is.

    Texts of under three bytes have no triplet, so all codes 0, and differ by their length code alone.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    length = min(255, int(np.log(len(data) + 1) / np.log(LENGTH_STEP)))
    c = counts(data)
    q = np.sort(c)[[BUCKETS // 4, BUCKETS // 2, BUCKETS * 3 // 4]]
    code = (c > q[0]).astype(np.uint8) + (c > q[1]) + (c > q[2])
    packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    return f"{length:02x}{packed.astype(np.uint8).tobytes().hex()}"


def _codes(fp: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fp[2:]), dtype=np.uint8)
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel().astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 from a difference score of ZERO_AT a bucket on; symmetric."""
    if a == b:
        return 1.0
    x, y = _codes(a), _codes(b)
    score = COST[np.abs(x - y)].sum() + min(LENGTH_MOST, abs(int(a[:2], 16) - int(b[:2], 16)))
    return float(max(0.0, 1 - score / (ZERO_AT * BUCKETS)))


def edited(text: str | None, following: str | None) -> str:
    """The text whose last third is the start (or all) of the following document."""
    t = text or ""
    k = len(t) // 3
    return t[: len(t) - k] + (following or "")[:k]


def _row(doc_id, text: str, fp: str, following: str, next_fp: str) -> tuple:
    changed = edited(text, following)
    efp = fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, fp, efp, likeness(fp, efp), likeness(fp, next_fp)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is joined with the one after it. A partition's first and last text go along for its borders."""
    part, last, begun = TaskContext.get().partitionId(), None, False

    def batch_of(rows: list[tuple], kind: str | None, text: str | None) -> pa.RecordBatch:
        n = len(rows)
        more = [pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())]
        return pa.RecordBatch.from_arrays([*_columns(rows), *more], names=[*_NAMES, "kind", "part", "body"])

    for batch in batches:
        done = []
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            text = t.as_py() or ""
            fp = fingerprint(text)
            if not begun:
                begun = True
                yield batch_of([(None, None, None, fp, None, None, None)], "first", text)
            if last is not None:
                done.append(_row(*last, text, fp))
            last = (i.as_py(), text, fp)
        if done:
            yield batch_of(done, None, None)
    if last is not None:
        yield batch_of([(last[0], None, None, last[2], None, None, None)], "last", last[1])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(r["doc_id"], r["body"], r["fingerprint"], r["next_body"], r["next_fp"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays(_columns(rows), names=_NAMES)


def fingerprint_documents(docs: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of the whole text and of its edited text, and the likeness to it and to the next document.

    Documents follow each other by descending id (null ids last, equal ids by text), after the last comes the first. One
    range shuffle of the texts puts neighbours into a partition; only the first and last text of each partition meet
    again, one row a partition. Null texts count as empty; an only document is its own next one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    done = scratch.save(ranged.mapInArrow(_neighbours, RESULT + ", kind string, part int, body string"), "fingerprints")
    first = done.where("kind = 'first'").select("part", F.col("body").alias("b"), F.col("fingerprint").alias("f"))
    after = Window.orderBy("part")  # one row a partition
    wrap = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = first.select(
        F.col("part").alias("_part"),
        F.coalesce(F.lead("b").over(after), F.first("b").over(wrap)).alias("next_body"),
        F.coalesce(F.lead("f").over(after), F.first("f").over(wrap)).alias("next_fp"),
    )
    last = done.where("kind = 'last'").select("doc_id", "fingerprint", "body", "part")
    ends = last.join(following, last["part"] == following["_part"]).select("doc_id", "fingerprint", "body", "next_body", "next_fp")
    return done.where("kind IS NULL").select(*_NAMES).unionByName(ends.mapInArrow(_borders, RESULT))
