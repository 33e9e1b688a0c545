"""Operator 2: language identification with hyperdimensional profiles.

Method: every letter has a random vector of +1 and -1; the vectors of the letters of an
n-gram are rotated by their place (permuted) and multiplied (bound) into the n-gram's
vector; a text's n-gram vectors are summed (bundled) into its profile, and the profiles of
a language's training documents into the language's prototype. A document gets the
language of the prototype with the largest cosine.

The vectors follow from the code point and the seed alone, so no alphabet is fitted and
training sends one vector for each language from each task, whatever the input's size.
Distinct n-grams of a slice are counted first and their vectors weighted by the counts,
which gives the same sums as adding one vector for each place in the text.

Defined results: null text or a text without letters is ``und`` with score 0; ties go to
the language that sorts first; rows without language, or whose doc_id is null, teach
nothing; without any training row every document is ``und``; repeated rows count as often
as they occur; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import SLICE_BYTES, slices, table, text_buffer

DIMENSIONS = 1024
ORDER = 3
SEED = 11
FOLDS = 5
#: Slices with at most this many distinct letters count n-grams by position in a dense table.
SMALL_ALPHABET = 80
#: Texts of one table of counts.
MOST_ROWS = 400


@lru_cache(1 << 16)
def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[seed, code])).integers(0, 2, dimensions)
    return (2 * bits - 1).astype(np.int8)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet with 0 for the gap, index into it of each symbol, text of each symbol).

    Letters are lower-cased; each run of anything else is one gap, and a gap stands before and after every text.
    """
    lower = [t.lower() for t in texts]
    joined = "\0".join(["", *lower, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, index = np.unique(codes, return_inverse=True) if codes.max(initial=0) > 0xFFFF else _small_unique(codes)
    letter = np.array([chr(c).isalpha() for c in alphabet.tolist()], bool)
    renumber = np.where(letter, np.cumsum(letter), 0)
    alphabet = np.concatenate([[0], alphabet[letter]])
    index = renumber[index]
    doc = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in lower)])
    doc = np.minimum(doc, len(texts))
    keep = np.ones(len(index), bool)
    keep[1:] = (index[1:] > 0) | (index[:-1] > 0)
    return alphabet, index[keep], doc[keep]


def _small_unique(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(1 << 16, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(1 << 16, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[codes]


def gram_counts(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of each distinct n-gram, n-gram number, text number) of every n-gram with a letter."""
    alphabet, index, doc = symbols(texts)
    n, size = len(index) - order + 1, len(alphabet)
    if n <= 0:
        return np.zeros((0, order), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = index.astype(np.int64)
    code = np.zeros(n, np.int64)
    letters = np.zeros(n, bool)
    inner = np.zeros(n, bool)  # a gap strictly inside parts words
    for k in range(order):
        part = index[k : k + n]
        code = code * size + part
        letters |= part > 0
        if 0 < k < order - 1:
            inner |= part == 0
    keep = letters & ~inner
    # The gap between two texts is shared: an n-gram belongs to the text of its middle symbol, a letter.
    owner = doc[order // 2 : order // 2 + n]
    code, owner = code[keep], owner[keep] - 1
    if size <= SMALL_ALPHABET and order <= 3:
        seen = np.zeros(size**order, bool)
        seen[code] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(size**order, np.int64)
        place[distinct] = np.arange(len(distinct))
        number = place[code]
    else:
        distinct, number = np.unique(code, return_inverse=True)
    places = np.stack([distinct // size ** (order - 1 - k) % size for k in range(order)], 1)
    return alphabet[places], number, owner


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors, one row for each n-gram: the letter at place k is rotated by (order - 1 - k)."""
    order = grams.shape[1]
    out = np.ones((len(grams), dimensions), np.int8)
    codes, where = np.unique(grams, return_inverse=True)
    where = where.reshape(grams.shape)
    letters = np.stack([letter_vector(c, dimensions, seed) for c in codes.tolist()]) if len(codes) else np.zeros((0, dimensions), np.int8)
    for k in range(order):
        out *= np.roll(letters, order - 1 - k, axis=1)[where[:, k]]
    return out.astype(np.float32)


def counts_by_row(number: np.ndarray, row: np.ndarray, rows: int, grams: int) -> np.ndarray:
    return np.bincount(row * grams + number, minlength=rows * grams).reshape(rows, grams).astype(np.float32)


def profiles(texts: list[str], dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The bundled vectors of texts, one row for each."""
    grams, number, row = gram_counts(texts)
    vectors = gram_vectors(grams, dimensions, seed)
    return counts_by_row(number, row, len(texts), len(grams)) @ vectors if len(grams) else np.zeros((len(texts), dimensions), np.float32)


def held_out_fold():
    """True where crc32 of the doc_id as text leaves no remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def text_batches(column, most: int = SLICE_BYTES // 2):
    _, offsets = text_buffer(column)
    for low, high in slices(offsets, most):
        for i in range(low, high, MOST_ROWS):
            j = min(high, i + MOST_ROWS)
            yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


def train(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by language from the columns ``text`` and ``lang``; only one vector for each language reaches the driver."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, texts in text_batches(batch.column(0)):
                names = sorted(set(langs[i:j]))
                grams, number, row = gram_counts(texts)
                if not len(grams):
                    continue
                which = np.array([names.index(x) for x in langs[i:j]])
                bundled = counts_by_row(number, which[row], len(names), len(grams)).astype(np.float64) @ gram_vectors(grams, dimensions, seed)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + bundled[k]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    added = rows.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v")).collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(found, key=lambda r: r["lang"]) if any(r["v"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = SEED) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each row of ``docs``; only text is looked at."""
    names = list(prototypes)
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).astype(np.float32) if names else None

    def run(batches):
        for batch in batches:
            guess, score = [], []
            for _, _, texts in text_batches(batch.column(2)):
                if unit is None:
                    guess += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                made = profiles(texts, unit.shape[1], seed)
                norm = np.linalg.norm(made, axis=1)
                cosine = made @ unit.T / np.maximum(norm, 1e-9)[:, None]
                best = cosine.argmax(1)
                letters = norm > 0
                guess += [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
                score += np.where(letters, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(guess, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_fold().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0))
    return predict(docs, learned)
