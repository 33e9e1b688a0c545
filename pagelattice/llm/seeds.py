"""Winnowed anchors and the runs of windows that hang on them.

A window is ``width`` consecutive units (words or bytes) of a document and holds
``width - gram + 1`` grams. Its anchor is the gram with the smallest hash, the leftmost
among equals, so equal windows have equal anchors at equal places. The windows of one
document that share an anchor occurrence stand next to each other: a *run*. Two
documents can only share a window where they have runs on equal anchors, and runs
that are equal as a whole share all their windows. There are about
``2 / (width - gram + 2)`` runs for each unit of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pagelattice.llm.common import U64

#: Places in one sliding minimum; longer inputs are handled in overlapping pieces.
PLACE_BITS = 24
_PLACE = U64((1 << PLACE_BITS) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        rest = width - done
        values = np.minimum(values[:-rest], values[rest:])
    return values


def anchors(grams: np.ndarray, per: int) -> np.ndarray:
    """The place of the anchor of every window of ``per`` grams."""
    n = len(grams) - per + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    most = 1 << PLACE_BITS
    out = np.empty(n, np.int64)
    step = most - per
    for begin in range(0, n, step):
        end = min(n, begin + step)
        part = grams[begin : end + per - 1]
        keyed = (part & ~_PLACE) | np.arange(len(part), dtype=U64)
        out[begin:end] = (sliding_min(keyed, per) & _PLACE).astype(np.int64) + begin
    return out


def runs(grams: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first window, number of windows) of every run; ``first``: the first unit of each document and the end."""
    units = int(first[-1])
    n = units - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    where = anchors(grams, width - gram + 1)
    end = np.repeat(first[1:], np.diff(first))[:n]
    valid = np.flatnonzero(np.arange(n) + width <= end)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3
    chosen = where[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1)
    at = np.flatnonzero(new)
    return chosen[at], valid[at], np.diff(np.append(at, len(valid)))


ROWS = "kind byte, a long, s long, doc_id long, th int, lo int, n int"
COLUMNS = ("kind", "a", "s", "doc_id", "th", "lo", "n")
KINDS = (np.int8, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
#: kind: REMOVED rows are windows (lo, n) that a smaller place holds too; OPEN rows are yet to be compared at
#: their anchor. WIDE rows hang on an anchor with so many texts that they are compared window by window at once;
#: PASSED rows are such rows on their way, dealt evenly instead of to the anchor.
REMOVED, OPEN, WIDE, PASSED = 0, 1, 2, 3
#: Different run texts on one anchor within a batch that make the anchor a wide one.
MANY = 6


@dataclass
class Rows:
    """Runs as columns."""

    a: np.ndarray
    s: np.ndarray
    doc_id: np.ndarray
    th: np.ndarray
    lo: np.ndarray
    n: np.ndarray

    def take(self, at) -> Rows:
        return Rows(*(getattr(self, c)[at] for c in COLUMNS[1:]))

    def __len__(self) -> int:
        return len(self.a)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(p, c) for p in parts]) if parts else np.zeros(0, k) for c, k in zip(COLUMNS[1:], KINDS[1:])))

    def batch(self, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self), kind, np.int8)), *(pa.array(getattr(self, c).astype(k, copy=False)) for c, k in zip(COLUMNS[1:], KINDS[1:]))], list(COLUMNS))


def from_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, Rows]:
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS]
    return columns[0], Rows(*columns[1:])


def order(rows: Rows) -> Rows:
    return rows.take(np.lexsort((rows.lo, rows.doc_id, rows.s, rows.a)))


def repeats(rows: Rows, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ordered rows: (begins an anchor, begins a run's text, is removed by the first row with the same text)."""
    new_a = np.ones(len(rows), bool)
    new_a[1:] = rows.a[1:] != rows.a[:-1]
    new_s = new_a.copy()
    new_s[1:] |= rows.s[1:] != rows.s[:-1]
    first = np.maximum.accumulate(np.where(new_s, np.arange(len(rows)), 0))
    if same_doc:  # a repeated row is the same place
        return new_a, new_s, (rows.doc_id != rows.doc_id[first]) | (rows.lo != rows.lo[first]) | (rows.th != rows.th[first])
    return new_a, new_s, rows.doc_id > rows.doc_id[first]


def chained(rows: Rows) -> Rows:
    """Of ordered rows: equal runs of one document that follow each other without a gap (text that repeats itself) as
    one, since what removes one of them removes all."""
    if not len(rows):
        return rows
    on = np.zeros(len(rows), bool)
    on[1:] = rows.lo[1:] == rows.lo[:-1] + rows.n[:-1]
    for c in ("a", "s", "doc_id", "th"):
        v = getattr(rows, c)
        on[1:] &= v[1:] == v[:-1]
    begin = np.flatnonzero(~on)
    out = rows.take(begin)
    out.n = np.add.reduceat(rows.n, begin).astype(np.int32)
    return out


def spread(rows: Rows) -> Rows:
    """Removed rows with an anchor that is spread evenly: they only pass through the next shuffle."""
    mixed = (rows.doc_id.astype(np.int64) * np.int64(-7046029254386353131)) ^ (rows.lo.astype(np.int64) * np.int64(0x2545F4914F6CDD1D))
    return Rows(mixed, np.zeros(len(rows), np.int64), rows.doc_id, rows.th, rows.lo, rows.n)


def merged(rows: Rows) -> Rows:
    """Removed rows of a document that follow each other or overlap, as one."""
    if not len(rows):
        return rows
    at = np.lexsort((rows.lo, rows.th, rows.doc_id))
    rows = rows.take(at)
    end = rows.lo.astype(np.int64) + rows.n
    doc = np.cumsum(np.concatenate([[True], (rows.doc_id[1:] != rows.doc_id[:-1]) | (rows.th[1:] != rows.th[:-1])]))
    reach = np.maximum.accumulate(end + (doc << 33)) - (doc << 33)
    new = np.ones(len(rows), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rows.lo[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(rows)) - 1
    out = rows.take(begin)
    out.n = (reach[last] - rows.lo[begin]).astype(np.int32)
    return out


def settle_here(parts: list[Rows], same_doc: bool):
    """Batches for the rows of one task's batch: what equal runs within it remove already, and the rest.

    Of an anchor with many texts two rows go on to it, after a mark that tells it so; the others pass it by.
    """
    rows = order(Rows.joined(parts))
    if not len(rows):
        return
    rows = rows if same_doc else chained(rows)
    new_a, new_s, gone = repeats(rows, same_doc)
    if gone.any():
        yield spread(merged(rows.take(gone))).batch(REMOVED)
    group = np.cumsum(new_a) - 1
    texts = np.bincount(group, new_s)
    text = np.cumsum(new_s)
    nth = text - text[np.maximum.accumulate(np.where(new_a, np.arange(len(rows)), 0))]  # of its anchor's texts
    wide = texts[group] > MANY
    told = new_a & wide
    if told.any():  # a row without windows sorts before the anchor's own and marks it
        mark = rows.take(told)
        mark.s, mark.n = np.full(len(mark), np.iinfo(np.int64).min), np.zeros(len(mark), np.int32)
        yield mark.batch(OPEN)
    for kind, these in ((OPEN, ~gone & (~wide | (nth < 2))), (PASSED, ~gone & wide & (nth >= 2))):
        if these.any():
            out = rows.take(these)
            yield (spread(out) if kind == PASSED else out).batch(kind)


def settle(batches, same_doc: bool):
    """Of rows ordered by (a, s, doc_id, lo) and dealt by ``a``: REMOVED rows, and the first of each run text whose
    anchor has several, which must be compared further: OPEN, or WIDE where the anchor is marked as a wide one.

    Streams: only the rows of one run text in one document are held, however many rows an anchor has.
    """
    carry, several, marked = None, False, None
    for batch in batches:
        kind, rows = from_batch(batch)
        for k, as_ in ((REMOVED, REMOVED), (PASSED, WIDE)):
            if (kind == k).any():
                yield rows.take(kind == k).batch(as_)
        rows = rows.take(kind == OPEN)
        marks = rows.a[rows.n == 0]
        rows = rows.take(rows.n > 0)
        if not len(rows):
            marked = marks[-1] if len(marks) else marked
            continue
        if carry is not None:
            rows = Rows.joined([carry, rows])
        wide = np.isin(rows.a, marks if marked is None else np.append(marks, marked))
        marked = marks[-1] if len(marks) else marked
        new_a, new_s, gone = repeats(rows, same_doc)
        group = np.cumsum(new_a) - 1
        mixed = np.bincount(group, new_s) > 1
        if several and carry is not None:
            mixed[0] = True
        last = group == group[-1]
        tail = np.cumsum(new_s)
        tail = tail == tail[-1]
        if gone.any():
            yield merged(rows.take(gone)).batch(REMOVED)
        out = ~gone & (mixed[group] | wide) & ~(last & tail)
        for k, these in ((OPEN, out & ~wide), (WIDE, out & wide)):
            if these.any():
                yield rows.take(these).batch(k)
        carry = rows.take(~gone & last & tail)
        several, broad = bool(mixed[-1]) or bool(wide[-1]), bool(wide[-1])
    if carry is not None and several:
        yield carry.batch(WIDE if broad else OPEN)
