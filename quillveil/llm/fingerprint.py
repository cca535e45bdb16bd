"""Document fingerprints: bottom-k sketches of hashed word shingles.

The fingerprint of a text is the number of its values and the k smallest distinct 32-bit hashes of its 5-word shingles, as
hexadecimal digits. Fingerprints of parts merge into that of the whole (`merge`), and two of them estimate resemblance,
containment and the number of distinct shingles.

Edge cases: a null or empty text, or one of white space, has the fingerprint "" of the empty set; the resemblance of two
empty sets is 1, of an empty and another set 0. A text of one to four words is one shingle. Equal texts, repeated rows
included, have equal fingerprints; long texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.text import pieces, shingles, text_buffer
from quillveil.llm.workers import lean

K = 128
#: Bytes of text in a range of ids: from the one with few ranges to the other with many; tasks at most, each of several ranges then.
LEAST_BYTES, MOST_BYTES, TASKS = 4 << 20, 64 << 20, 100_000
#: Where rows without doc_id stand among the ids.
_NO_ID = -(1 << 63)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 8 * k:  # repeats can hide distinct values, so the cut is kept only if it leaves enough
        cut = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(cut) > k:
            return cut[:k]
    return np.unique(hashes)[:k]


def fingerprints(column: pa.Array, k: int = K) -> list[np.ndarray]:
    buffer, offsets = text_buffer(column)
    out = []
    for a, b in pieces(offsets):
        hashes, ends = shingles(buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        out += [bottom(hashes[ends[r] : ends[r + 1]], k) for r in range(b - a)]
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The fingerprint of the union of two sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**32 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A | B|; exact if the union has at most k values."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    same = both[1:] == both[:-1]
    repeated = both[1:][same]
    n = min(k, len(both) - len(repeated))
    if len(both) - len(repeated) > k:
        first = np.concatenate(([True], ~same))
        repeated = repeated[repeated <= both[first][k - 1]]
    return len(repeated) / n


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A|; 1 for an empty A."""
    if not len(a):
        return 1.0
    union = merge(a, b, k)
    shared = resemblance(a, b, k) * distinct(union, k)
    return min(1.0, shared / distinct(a, k))


def with_next(df: DataFrame, blocks: int) -> DataFrame:
    """Rows (part, doc_id, text, own): each part holds a range of ids in order and, last, the rows of the id that follows it.

    The ranges come from approximate quantiles; what goes to the driver, and to each task, is two numbers for each range.
    """
    rows = df.select(F.col("doc_id").cast("long"), F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 4 * blocks)).first()[0] or []
    shared = np.unique(np.array(cuts, np.int64))
    cut = df.sparkSession.sparkContext.broadcast(shared)

    @F.pandas_udf("long")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut.value, key.to_numpy(), "right"))

    held = rows.select("key", part_of("key").alias("part")).groupBy("part").agg(F.min("key").alias("first")).toArrow()
    order = np.argsort(held["part"].to_numpy(), kind="stable")
    parts, firsts = held["part"].to_numpy()[order], held["first"].to_numpy()[order]
    ranges = df.sparkSession.sparkContext.broadcast((parts, firsts))

    @F.pandas_udf("array<long>")
    def parts_of(key: pd.Series) -> pd.Series:
        """The row's part; and if its id opens it, the part before (of the smallest id, the last)."""
        numbers, opening = ranges.value
        own = np.searchsorted(cut.value, key.to_numpy(), "right")
        at = np.searchsorted(numbers, own)
        before = numbers[at - 1]
        opens = opening[at] == key.to_numpy()
        return pd.Series([[a, b] if o else [a] for a, b, o in zip(own.tolist(), before.tolist(), opens.tolist(), strict=True)], dtype=object)

    return rows.select("doc_id", "text", "key", F.posexplode(parts_of("key")).alias("i", "part")).select("part", "doc_id", "text", (F.col("i") == 0).alias("own"), "key")


def compare_edited(df: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint each text and its edited text, whose last floor(n / 2) code points are the first ones of the next document.

    Next is by ascending doc_id; the last document is followed by the first. Rows with one id are ordered by text, rows without
    an id come first. Texts are dealt once, by ranges of ids.
    """
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(24, total // min(MOST_BYTES, max(LEAST_BYTES, total // 2000))))
    dealt = with_next(df, blocks)
    ordered = dealt.repartition(min(blocks, TASKS), "part").sortWithinPartitions("part", F.desc("own"), "key", "text").drop("key")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(ids: list[int], texts: list[str], sketches: list[np.ndarray], n: int):
        """The first n rows against those that follow them."""
        edited = []
        for i in range(n):
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        marks = fingerprints(pa.array(edited, pa.large_string()), k)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:n], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(s) for s in sketches[:n]], pa.string()),
                pa.array([to_text(s) for s in marks], pa.string()),
                pa.array([resemblance(s, t, k) for s, t in zip(sketches[:n], marks, strict=True)], pa.float64()),
                pa.array([resemblance(sketches[i], sketches[i + 1], k) for i in range(n)], pa.float64()),
            ],
            names=names,
        )

    def run(batches):
        ids, texts, sketches, part, closed = [], [], [], None, False
        for batch in batches:
            column = batch.column(2).fill_null("")
            for a in range(0, len(column), 500):
                piece = column.slice(a, 500)
                marks = fingerprints(piece, k)
                for p, i, t, own, s in zip(batch.column(0).slice(a, 500).to_pylist(), batch.column(1).slice(a, 500).to_pylist(), piece.to_pylist(), batch.column(3).slice(a, 500).to_pylist(), marks, strict=True):
                    if p != part:
                        ids, texts, sketches, part, closed = [], [], [], p, False
                    if closed:  # rows that repeat the first id of the next part
                        continue
                    ids.append(i)
                    texts.append(t)
                    sketches.append(s)
                    if not own:
                        closed = True
                        if len(ids) > 1:
                            yield compare(ids, texts, sketches, len(ids) - 1)
                        ids, texts, sketches = [], [], []
                if len(ids) > 1 and not closed:
                    yield compare(ids, texts, sketches, len(ids) - 1)
                    ids, texts, sketches = ids[-1:], texts[-1:], sketches[-1:]

    return ordered.mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
