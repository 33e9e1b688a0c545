"""Operator 5: byte-level dedup with run-length compressed suffix indexes.

Method: texts are joined on winnowed anchors (see ``seeds``). Runs that are equal as a
whole are settled by their hashes. Where different runs hang on one anchor, their bytes go
to the anchor's task, which builds a run-length index over them: the suffix order gives
the Burrows-Wheeler transform, of which only the run ends are sampled (their text position,
the position of the suffix before and the length of the common prefix). From those samples
the matching statistics of every text position are streamed: between two samples the
matched position moves on by one and the length falls by one. Positions whose length
reaches ``WIDTH`` are chained to what they match; all but the first of a chain are marked.

An index covers at most about ``BLOCK_BYTES``. The rows of an anchor with many texts (a
common line with other text around it each time), or with more distinct bytes than that,
are not gathered: their windows are dealt by their own 128-bit hashes and settled there,
so no task holds a group that grows with the corpus.

Defined results: texts are UTF-8 bytes, null counts as empty; a match never crosses
documents; the order is doc_id, then start; rows that repeat a doc_id and its text are one
document and keep the same; rows with one doc_id and different texts are compared by
start; a null doc_id neither removes nor is removed; an empty table gives an empty result; extra columns
are never read. Kept bytes need not be valid UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import BYTES_1, BYTES_2, EIGHT, Written, byte_values, ids_of, sha, slices, table, text_buffer
from pagelattice.llm.seeds import COLUMNS, REMOVED, ROWS, WIDE, Rows, merged, runs, settle, settle_here, spread
from pagelattice.llm.substring_dedup import keyed

WIDTH = 100
GRAM = 32
BLOCK_BYTES = 1 << 20


def _slices(batch):
    data, offsets = text_buffer(batch.column(2))
    for i, j in slices(offsets, 1 << 19):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _runs(width: int, gram: int):
    def run(batches):
        for batch in batches:
            doc_id, th = ids_of(batch.column(0)), ids_of(batch.column(1))
            parts = []
            for i, _, data, first in _slices(batch):
                one, two = byte_values(data)
                grams = BYTES_1.grams(BYTES_1.prefix(one), gram - EIGHT)
                place, lo, n = runs(grams, first, width, gram)
                if not len(lo):
                    continue
                doc = np.searchsorted(first, lo, "right") - 1
                text = BYTES_2.ranges(BYTES_2.prefix(two), lo, lo + n + (width - 1 - EIGHT)) + n.astype(np.uint64)
                parts.append(Rows(grams[place].view(np.int64), text.view(np.int64), doc_id[i + doc], th[i + doc], (lo - first[doc]).astype(np.int32), n.astype(np.int32)))
            yield from settle_here(parts, same_doc=True)

    return run


PIECES = "a long, doc_id long, th int, lo int, n int, bytes binary, s long, kind byte"
PIECE_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int8())
PIECE_NAMES = ["a", "doc_id", "th", "lo", "n", "bytes", "s", "kind"]


def _windows(rows, width: int):
    """Batches of the windows of rows (a, doc_id, th, lo, n, bytes), settled as far as they meet here."""
    raw = np.frombuffer(b"".join([r[5] for r in rows]), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])])[:-1]
    n = np.array([r[4] for r in rows])
    piece = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[piece] + offset
    first, second = byte_values(raw)
    one = BYTES_1.ranges(BYTES_1.prefix(first), at, at + width - EIGHT)
    two = BYTES_2.ranges(BYTES_2.prefix(second), at, at + width - EIGHT)
    doc_id, th, lo = (np.array([r[c] for r in rows], np.int64)[piece] for c in (1, 2, 3))
    yield from settle_here([Rows(one.view(np.int64), two.view(np.int64), doc_id, th.astype(np.int32), (lo + offset).astype(np.int32), np.ones(len(at), np.int32))], same_doc=True)


def _pieces(width: int, most: int = 4096):
    """Of rows (doc_id, th, text, runs): a row with the bytes of each listed run, and the windows of the wide ones (without bytes)."""

    def run(batches):
        for batch in batches:
            listed = batch.column(3)
            if listed.null_count == len(listed):
                continue
            doc_id, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = text_buffer(batch.column(2))
            raw = data.tobytes()
            out, wide = [], []
            for k, found in enumerate(listed.to_pylist()):
                at = int(offsets[k])
                for x in found or ():
                    row = (x["a"], doc_id[k], th[k], x["lo"], x["n"], raw[at + x["lo"] : at + x["lo"] + x["n"] + width - 1], 0, 0)
                    (wide if x["kind"] == WIDE else out).append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECE_KINDS)], PIECE_NAMES)
            for i in range(0, len(wide), most):
                for made in _windows(wide[i : i + most], width):
                    yield pa.RecordBatch.from_arrays([*(made.column(made.schema.get_field_index(c)) for c in ("a", "doc_id", "th", "lo", "n")), pa.nulls(made.num_rows, pa.binary()), made.column(made.schema.get_field_index("s")), made.column(0)], PIECE_NAMES)

    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of pieces, with samples at the run ends.

    ``text``: the pieces, each followed by a separator of its own. ``at``: sampled text
    positions in order; ``before`` and ``common``: the position of the suffix that sorts just
    before the sampled one, and the length of their common prefix.
    """

    def __init__(self, pieces: list[bytes]):
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text = np.zeros(int(lengths.sum()) + count, np.int64)
        spots = np.ones(len(text), bool)
        spots[self.begin + lengths] = False
        text[spots] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + count
        text[~spots] = np.arange(count)
        self.text = text
        order, place = self._suffixes(text)
        last = text[order - 1]  # the transform: what stands before each suffix
        head = np.ones(len(text), bool)
        head[1:] = last[1:] != last[:-1]
        self.runs = int(head.sum())
        at = order[head]
        before = order[np.maximum(np.flatnonzero(head) - 1, 0)]
        common = self._common(at, before)
        common[0] = 0
        by_place = np.argsort(at)
        self.at, self.before, self.common = at[by_place], before[by_place], common[by_place]

    @staticmethod
    def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, place of each) by prefix doubling."""
        n = len(text)
        rank, step, top = text, 1, int(text.max(initial=0)) + 2
        while top**2 < 1 << 31 and step < 4:  # pack neighbouring symbols before the first sort
            padded = np.zeros(n, np.int64)
            padded[: n - step] = rank[step:] + 1
            rank, top, step = rank * top + padded, top * top, step * 2
        while True:
            padded = np.zeros(n, np.int64)
            padded[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + padded if int(rank.max(initial=0)) < 1 << 31 else None
            if key is None:
                order = np.argsort(rank, kind="stable")
                ordered = rank[order]
            else:
                order = np.argsort(key, kind="stable")
                ordered = key[order]
                step *= 2
            new = np.ones(n, bool)
            new[1:] = ordered[1:] != ordered[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all() or step > n:
                return order, rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and at b; separators never match."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(a != b)
        n = len(self.text)
        k = 0
        while len(live):
            x, y = a[live] + k, b[live] + k
            ok = (x < n) & (y < n)
            ok[ok] = self.text[x[ok]] == self.text[y[ok]]
            live = live[ok]
            out[live] += 1
            k += 1
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every text position the position it matches and the match's length, streamed from the samples."""
        here = np.arange(len(self.text))
        sample = np.maximum(np.searchsorted(self.at, here, "right") - 1, 0)
        passed = here - self.at[sample]
        return self.before[sample] + passed, np.maximum(self.common[sample] - passed, 0)

    def repeats(self, width: int) -> np.ndarray:
        """True at the positions whose ``width`` bytes also start at an earlier position."""
        match, length = self.matching_statistics()
        here = np.arange(len(self.text))
        long = length >= width
        root = np.where(long, match, here)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        first = np.full(len(here), len(here))
        np.minimum.at(first, root, here)
        return first[root] < here


def _indexed(width: int, block_bytes: int):
    """Of pieces dealt and ordered by anchor, then place: REMOVED rows; windows of oversized anchors as OPEN rows."""

    def block(rows):
        index = RunLengthIndex([r[5] for r in rows])
        repeated = index.repeats(width)
        doc_id, th, lo, n = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3, 4))
        at = np.flatnonzero(repeated)
        piece = np.searchsorted(index.begin, at, "right") - 1
        offset = at - index.begin[piece]
        ok = offset < n[piece]
        piece, offset = piece[ok], offset[ok]
        if len(piece):
            found = Rows(np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64), doc_id[piece], th[piece].astype(np.int32), (lo[piece] + offset).astype(np.int32), np.ones(len(piece), np.int32))
            yield spread(merged(found)).batch(REMOVED)

    def windows(rows):
        return _windows(rows, width)

    def run(batches):
        held, size = [], 0  # whole groups, ready for an index
        group, group_size, over = [], 0, None
        for batch in batches:
            made = batch.column(5).is_null()
            if made.true_count:  # windows on their way
                passed = batch.filter(made)
                yield pa.RecordBatch.from_arrays([passed.column(passed.schema.get_field_index(c)) for c in COLUMNS], list(COLUMNS))
                batch = batch.filter(batch.column(5).is_valid())
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if group and r[0] != group[0][0]:
                    if over == group[0][0]:
                        yield from windows(group)
                    else:
                        if held and size + group_size > block_bytes:
                            yield from block(held)
                            held, size = [], 0
                        if len(group) > 1:
                            held += group
                            size += group_size
                    group, group_size, over = [], 0, None
                if group and r[:4] == group[-1][:4]:
                    continue  # a repeated row is the same place
                group.append(r)
                group_size += len(r[5])
                if group_size > block_bytes:
                    over = r[0]
                    yield from windows(group)
                    group, group_size = [], 0
        if over is not None:
            if group:
                yield from windows(group)
        elif len(group) > 1:
            held += group
        if held:
            yield from block(held)

    return run


def _settled(rows: DataFrame) -> DataFrame:
    return rows.repartition("a").sortWithinPartitions("a", "s", "doc_id", "lo").mapInArrow(lambda batches: settle(batches, True), ROWS)


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, th, text, found): each document with the ranges (lo, n) of its repeated windows, null if none."""
    rows = keyed(docs)
    keys = ["doc_id", "th"]
    once = rows.where("doc_id is not null")
    first = Written(_settled(once.mapInArrow(_runs(width, gram), ROWS)))
    listed = first.df.where(F.col("kind") != REMOVED).groupBy(*keys).agg(F.collect_list(F.struct("a", "lo", "n", "kind")).alias("runs"))
    pieces = rows.join(listed, keys, "left").select("doc_id", "th", "text", "runs").mapInArrow(_pieces(width), PIECES)
    marked = pieces.repartition("a").sortWithinPartitions("a", "doc_id", "th", "lo").mapInArrow(_indexed(width, block_bytes), ROWS)
    second = _settled(marked)
    gone = first.df.where(F.col("kind") == REMOVED).select(*COLUMNS).union(second.where(F.col("kind") == REMOVED))
    found = gone.groupBy(*keys).agg(F.collect_list(F.struct("lo", "n")).alias("found"))
    return rows.join(found, keys, "left").select("doc_id", "th", "text", "found")


def kept_ranges(length: int, found, width: int) -> list[tuple[int, int]]:
    """(start, end) of the removed spans of a text, maximal and in order."""
    out: list[list[int]] = []
    for x in sorted((x["lo"], x["n"]) for x in found or ()):
        a, b = x[0], min(length, x[0] + x[1] + width - 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document its bytes, the removed ones, the removed spans and the digest of the rest."""

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, digests = [], [], [], []
            data, offsets = text_buffer(batch.column(2))
            raw = data.tobytes()
            for k, found in enumerate(batch.column(3).to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                spans = kept_ranges(b - a, found, width)
                kept, at = [], a
                for x, y in spans:
                    kept.append(raw[at : a + x])
                    at = a + y
                n_bytes.append(b - a)
                n_removed.append(sum(y - x for x, y in spans))
                n_spans.append(len(spans))
                digests.append(sha(b"".join([*kept, raw[at:b]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_windows(docs, width, gram, block_bytes).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
