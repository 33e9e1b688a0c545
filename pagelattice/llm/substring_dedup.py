"""Operator 1: substring dedup by seed and extend.

Method: documents are joined on winnowed anchors (hashes of ``GRAM`` words, one for each
run of windows, see ``seeds``). Around a shared anchor the match is extended to both
sides, by keys rather than word by word: first to the whole run, left and right of the
anchor, which settles copies; where runs on the same anchor differ, to each split of the
missing words between the left and the right side, that is to every window that holds the
anchor. Matches of ``WIDTH`` words or more that a document with a smaller doc_id holds are
united into maximal repeats and cut.

Nothing is compared pair by pair: equal runs (and then equal windows) meet by two 64-bit
hashes of their own, over two independent hashes of each word, ordered by doc_id, and all
but the smallest are marked. A task settles its
own copies before the shuffle, so a passage held by a third of all documents reaches the
anchor's task once for each batch of rows; of a common line with other text around it each
time, two rows and a mark do, and the rest goes on to its windows at once. The task streams
and holds one run.

Defined results: null or empty text has no words and keeps none; rows with the same
doc_id are one place and don't remove each other; a null doc_id neither removes nor is
removed; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import WORDS_1, WORDS_2, Written, ids_of, sha, slices, table, text_buffer, text_key, word_hashes, word_spans
from pagelattice.llm.seeds import REMOVED, ROWS, Rows, runs, settle, settle_here

WIDTH = 50
GRAM = 25


def _slices(batch):
    """Of a batch (doc_id, th, text, ...): first row, last row, both hashes of the words, first word of each document."""
    data, offsets = text_buffer(batch.column(2))
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = word_spans(part, offsets[i : j + 1] - offsets[i])
        yield i, j, word_hashes(part, starts, ends), first


def _runs(width: int, gram: int):
    def run(batches):
        for batch in batches:
            doc_id, th = ids_of(batch.column(0)), ids_of(batch.column(1))
            parts = []
            for i, _, (words, others), first in _slices(batch):
                grams = WORDS_1.grams(WORDS_1.prefix(words), gram)
                place, lo, n = runs(grams, first, width, gram)
                doc = np.searchsorted(first, lo, "right") - 1
                text = WORDS_2.ranges(WORDS_2.prefix(others), lo, lo + n + (width - 1)) + n.astype(np.uint64)
                parts.append(Rows(grams[place].view(np.int64), text.view(np.int64), doc_id[i + doc], th[i + doc], (lo - first[doc]).astype(np.int32), n.astype(np.int32)))
            yield from settle_here(parts, same_doc=False)

    return run


def _windows(width: int):
    """Of rows (doc_id, th, text, runs): a row for each window of the listed runs."""

    def run(batches):
        for batch in batches:
            listed = batch.column(3)
            if listed.null_count == len(listed):
                continue
            doc_id, th = ids_of(batch.column(0)), ids_of(batch.column(1))  # rows with a null id have no runs
            parts = []
            for i, j, (words, others), first in _slices(batch):
                lo, doc = [], []
                for k, found in enumerate(listed.slice(i, j - i).to_pylist()):
                    for x in found or ():
                        lo.append(np.arange(x["lo"], x["lo"] + x["n"]) + first[k])
                        doc.append(np.full(x["n"], k))
                if not lo:
                    continue
                lo, doc = np.concatenate(lo), np.concatenate(doc)
                one = WORDS_1.ranges(WORDS_1.prefix(words), lo, lo + width)
                two = WORDS_2.ranges(WORDS_2.prefix(others), lo, lo + width)
                parts.append(Rows(one.view(np.int64), two.view(np.int64), doc_id[i + doc], th[i + doc], (lo - first[doc]).astype(np.int32), np.ones(len(lo), np.int32)))
            yield from settle_here(parts, same_doc=False)

    return run


def _settled(rows: DataFrame) -> DataFrame:
    return rows.repartition("a").sortWithinPartitions("a", "s", "doc_id", "lo").mapInArrow(lambda batches: settle(batches, False), ROWS)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, th, text, found): each document with the ranges (lo, n) of its repeated windows, null if none."""
    rows = keyed(docs)
    first = Written(_settled(rows.where("doc_id is not null").mapInArrow(_runs(width, gram), ROWS)))
    listed = first.df.where(F.col("kind") != REMOVED).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    keys = ["doc_id", "th"]
    windows = rows.join(listed, keys, "left").select("doc_id", "th", "text", "runs").mapInArrow(_windows(width), ROWS)
    second = _settled(windows)
    gone = first.df.where(F.col("kind") == REMOVED).union(second.where(F.col("kind") == REMOVED))
    found = gone.groupBy(*keys).agg(F.collect_list(F.struct("lo", "n")).alias("found"))
    return rows.join(found, keys, "left").select("doc_id", "th", "text", "found")


def _cut(width: int):
    def run(batches):
        for batch in batches:
            found = batch.column(3)
            data, offsets = text_buffer(batch.column(2))
            n_words, n_removed, digests = [], [], []
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                raw = part.tobytes()
                starts, ends, first = word_spans(part, offsets[i : j + 1] - offsets[i])
                starts, ends = starts.tolist(), ends.tolist()
                gone = np.zeros(len(starts) + 1, np.int64)
                for k, ranges in enumerate(found.slice(i, j - i).to_pylist()):
                    for x in ranges or ():
                        gone[first[k] + x["lo"]] += 1
                        gone[min(first[k] + x["lo"] + x["n"] + width - 1, first[k + 1])] -= 1
                removed = np.cumsum(gone)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(removed)])
                keep = ~removed
                for k in range(j - i):
                    a, b = int(first[k]), int(first[k + 1])
                    n_words.append(b - a)
                    n_removed.append(int(total[b] - total[a]))
                    digests.append(sha(b" ".join([raw[starts[w] : ends[w]] for w in (np.flatnonzero(keep[a:b]) + a).tolist()])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document its words, the removed ones and the digest of the rest."""
    return repeated_windows(docs, width, gram).mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
