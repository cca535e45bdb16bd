"""Language identification by a mixture of languages in each document.

Each language has the likelihoods of hashed 4-byte grams of lower-cased text, learned from labelled documents. A document is
cut into windows of 32 grams; its languages' proportions maximise the likelihood of its windows by expectation-maximisation.
That is done for the best one, two, three, ... up to all languages, and the set with the largest likelihood less a penalty for each
language is taken. The language with the largest proportion is the prediction, its proportion the score.

Learning reads a sample of about `SAMPLE` documents of each language, chosen by hash of doc_id; prediction reads all texts
whole.

Edge cases: a null text, or one without a letter (Unicode category L; numerals and signs are none), is `und` with score 0; rows without a language teach nothing; without any
labelled row every prediction is `und`; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.text import pieces, text_buffer
from quillveil.llm.workers import lean

#: Documents of each language that learning reads, about.
SAMPLE = 4000
BITS = 16
WINDOW = 32
#: Windows whose grams' likelihoods are gathered at once.
GATHERED = 1 << 14
_LETTER = regex.compile(r"\p{L}")
_PLAIN = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 32).astype(np.uint32)


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # grams x languages, log-likelihoods


def grams(buffer: np.ndarray) -> np.ndarray:
    """Hashed 4-byte grams at every byte of a buffer, the last three wrapped round."""
    x = _PLAIN[buffer]
    code = x | np.roll(x, -1) << 8 | np.roll(x, -2) << 16 | np.roll(x, -3) << 24
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pc.utf8_lower(column.fill_null("").cast(pa.large_string())))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the text and lang of documents that are not held out."""
    rows = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    share = F.create_map(*(x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, sample / n)))))
    chosen = rows.where(F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            buffer, offsets = _lowered(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                own = grams(buffer[offsets[i] : offsets[i + 1]])[: max(0, int(offsets[i + 1] - offsets[i]) - 3)]
                sums[lang] = sums.get(lang, 0) + np.bincount(own, minlength=1 << BITS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "gram", "n"])

    table = chosen.mapInArrow(lean(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # 2**BITS rows a language at most
    languages = sorted(lang for lang, _ in counts)
    sums = np.zeros((1 << BITS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    columns = np.array([place[x] for x in table["lang"].to_pylist()], int)
    sums[table["gram"].to_numpy(), columns] = table["n"].to_numpy()
    return Model(languages, np.log((sums + 0.5) / (sums.sum(0) + 0.5 * (1 << BITS))).astype(np.float32))


def _mixtures(windows: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document by expectation-maximisation among its allowed languages, and log-likelihoods."""
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    shares = allowed / allowed.sum(1, keepdims=True)
    top = windows.max(1, keepdims=True)
    likelihood = np.exp(np.maximum(windows - top, -700))
    for _ in range(rounds):
        joint = shares[doc] * likelihood
        total = joint.sum(1, keepdims=True)
        shares = np.add.reduceat(joint / np.maximum(total, 1e-300), first[:-1], axis=0) / sizes[:, None]
    total = (shares[doc] * likelihood).sum(1)
    return shares, np.add.reduceat(np.log(np.maximum(total, 1e-300)) + top[:, 0], first[:-1])


def infer(windows: np.ndarray, first: np.ndarray, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) of the language set chosen for each document, and which languages it holds.

    windows: log-likelihoods (windows x languages) of documents with at least one window each.
    """
    n, k = len(first) - 1, windows.shape[1]
    shares, _ = _mixtures(windows, first, np.ones((n, k)))
    order = np.argsort(-shares, axis=1, kind="stable")
    best, value = np.zeros((n, k)), np.full(n, -np.inf)
    cost = penalty * np.log(np.diff(first) + 1.0)
    for size in range(1, k + 1):
        allowed = np.zeros((n, k))
        np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
        shares, fit = _mixtures(windows, first, allowed)
        fit = fit - cost * size
        better = fit > value
        best[better], value[better] = shares[better], fit[better]
    return best, best > 0


def _windows(table: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the grams' rows of `table` over each window; of a long text, some windows at a time."""
    out = np.empty((len(starts), table.shape[1]))
    for a in range(0, len(starts), GATHERED):
        first = starts[a : a + GATHERED]
        end = starts[a + GATHERED] if a + GATHERED < len(starts) else len(codes)
        out[a : a + GATHERED] = np.add.reduceat(table[codes[first[0] : end]], first - first[0], axis=0)
    return out


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with columns lang_pred, score and languages (the chosen set with proportions, most first)."""
    names = [c for c in documents.columns if c not in ("lang_pred", "score", "languages")]
    languages, shared = model.languages, documents.sparkSession.sparkContext.broadcast(model.table)

    def run(batches):
        table = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            known = [bool(languages) and t is not None and _LETTER.search(t) is not None for t in texts]
            lang, score, mixture = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
            at = [i for i, k in enumerate(known) if k]
            if at:
                buffer, offsets = _lowered(batch.column(0).take(pa.array(at)))
                for a, b in pieces(offsets):
                    part, own = buffer[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    per = -(-np.diff(own) // WINDOW)
                    first = np.concatenate(([0], np.cumsum(per)))
                    starts = np.repeat(own[:-1] - WINDOW * first[:-1], per) + WINDOW * np.arange(first[-1])
                    windows = _windows(table, grams(part), starts)
                    shares, chosen = infer(windows, first)
                    for i, row, held in zip(at[a:b], shares, chosen, strict=True):
                        order = np.argsort(-row, kind="stable")[: int(held.sum())]
                        lang[i], score[i] = languages[order[0]], float(min(1.0, row[order[0]]))
                        mixture[i] = ",".join(f"{languages[j]}:{row[j]:.3f}" for j in order)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang), pa.array(score), pa.array(mixture)], names=[*names, "lang_pred", "score", "languages"])

    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())])
    return documents.select(F.col(text).cast("string").alias("\0text"), *(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), schema)
