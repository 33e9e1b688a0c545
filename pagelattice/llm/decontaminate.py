"""Operator 9: benchmark decontamination with a generalised suffix automaton.

Method: one suffix automaton over the words of all normalised benchmark items; the words
of every training document stream through it and carry the length of the longest match
that ends at each word. Where that length reaches a window (``WINDOW`` words, or a whole
shorter item) the window's words are hit, and the automaton's state names the items.

A match of two words or more can only stand where neighbouring words are neighbours in
some item, so stretches without such a pair are passed over with numpy; what streams
through the automaton gives the same lengths as the whole text would.

The automaton goes to every executor. It has at most two states for each benchmark word,
and the benchmark is taken in blocks of at most ``BLOCK_WORDS`` words (items are never
split), one automaton and one pass for each block, so what is sent has a fixed bound
whatever the size of the benchmark; findings are written between passes.

Defined results: null or wordless text has no words and no hits; null or wordless items
have no windows; items with equal words all count; repeated rows give repeated results
for documents and count once for items with the same id; items with a null id take part
in hits but are not listed; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import Written, ddl, fresh, sha, slices, table, text_buffer, word_hashes, word_spans

WINDOW = 10
BLOCK_WORDS = 250_000

#: Bytes that are not in a word: ASCII other than digits and letters (upper case is folded first).
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


class SuffixAutomaton:
    """The generalised suffix automaton of sequences of ints."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        made = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        self.link[q] = made
        return made

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and longest match length after one more symbol."""
        nxt, link = self.next, self.link
        while c not in nxt[state]:
            state = link[state]
            if state < 0:
                return 0, 0
            length = self.len[state]
        return nxt[state][c], length + 1


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = FOLD[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), OUTSIDE)
    return data, starts, ends


class Benchmark:
    """A block of benchmark items as an automaton, with the items that each window state names."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        numbers: dict[bytes, int] = {}
        sequences = []
        for _, text in items:
            data, starts, ends = words_of((text or "").encode())
            raw = data.tobytes()
            sequences.append([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())])
        self.ids = [i for i, _ in items]
        vocabulary = list(numbers)
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        bounds = np.cumsum([0, *map(len, vocabulary)])
        hashes, others = word_hashes(joined, bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        self.hashes, self.others, self.numbers = hashes[order], others[order], order.astype(np.int64)
        self.count = max(1, len(vocabulary))
        pairs = {a * self.count + b for s in sequences for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.single = np.zeros(self.count, bool)
        self.automaton = auto = SuffixAutomaton()
        for s in sequences:
            auto.add(s)
        #: State -> items that hold its window; state -> (length, item) of whole short items.
        self.whole: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for n, s in enumerate(sequences):
            state = length = 0
            for c in s:
                state, length = auto.step(state, length, c)
                while length >= window and auto.len[auto.link[state]] >= window:
                    state = auto.link[state]
                    length = auto.len[state]
                if length >= window:
                    self.whole.setdefault(state, set()).add(n)
            if s and len(s) < window:
                if len(s) == 1:
                    self.single[s[0]] = True
                state = 0
                for c in s:
                    state = auto.next[state][c]
                self.short.setdefault(state, []).append((len(s), n))

    def __len__(self) -> int:
        return self.count

    def numbers_of(self, hashes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The number of each word, known by both of its hashes, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.others[at] == others), self.numbers[at], -1)

    def match(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """(hit ranges, items) of a stretch of known words."""
        auto, window, link, length_of = self.automaton, self.window, self.automaton.link, self.automaton.len
        state = length = 0
        hits, items = [], set()
        for i, c in enumerate(words):
            state, length = auto.step(state, length, c)
            if length >= window:
                top = state
                while length_of[link[top]] >= window:
                    top = link[top]
                items |= self.whole.get(top, set())
                hits.append((i - length + 1, i + 1))
            if self.short:
                s, n = state, length
                while s > 0:
                    for size, item in self.short.get(s, ()):
                        if size <= n:
                            items.add(item)
                            hits.append((i - size + 1, i + 1))
                    s = link[s]
                    n = length_of[s]
        return hits, items


def blocks_of(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The different items in blocks of at most ``most`` words (an item with more is a block of its own); usually one block.

    Only the bytes of each block come to the driver here: with n blocks, n numbers.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    bound = 2 * most  # a word has a byte and a separator at least
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    if size <= bound:
        return [items]
    n = -(-2 * size // bound)
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        sums = items.groupBy(part.alias("part")).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("items")).collect()
        if all(r["b"] <= bound or r["items"] == 1 for r in sums):
            return [items.where(part == r["part"]) for r in sorted(sums, key=lambda r: r["part"])]
        n = 2 * n + 1


#: The automaton of the block at hand, by the block's name: tasks of one worker share it.
_BUILT: dict[str, Benchmark] = {}


def built(name: str, sent, window: int) -> Benchmark:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(sent.value, window)
    return _BUILT[name]


def _streamed(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, finish, schema: str) -> DataFrame:
    """``finish(columns, n_words, hits, items)`` of every batch: hit word ranges and sorted item ids of each row.

    One pass without a shuffle for each block of the benchmark; the last one finishes. What a pass finds is written
    before the next, so a worker holds one automaton.
    """
    names = docs.columns
    at = names.index("text")
    both = fresh(names, "hits", "items")
    between = ddl(docs, f"{both[0]} array<array<int>>", f"{both[1]} array<string>")
    out, written = docs, None
    blocks = blocks_of(benchmark, block_words)
    for number, block in enumerate(blocks):
        rows = [(r["item_id"], r["text"]) for r in block.collect()]  # bounded by block_words
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        name = uuid.uuid4().hex
        last_block = number == len(blocks) - 1

        def run(batches, sent=sent, name=name, number=number, last_block=last_block):
            bench = built(name, sent, window)
            for batch in batches:
                data, offsets = text_buffer(batch.column(at))
                n_words, hits, items = [], [], []
                for i, j in slices(offsets):
                    part = FOLD[data[offsets[i] : offsets[j]]]
                    starts, ends, first = word_spans(part, offsets[i : j + 1] - offsets[i], OUTSIDE)
                    n_words += np.diff(first).tolist()
                    found = scan(bench, word_hashes(part, starts, ends), first)
                    hits += [found[k][0] if k in found else [] for k in range(j - i)]
                    items += [sorted({bench.ids[x] for x in found[k][1]} - {None}) if k in found else [] for k in range(j - i)]
                columns = [batch.column(c) for c in range(len(names))]
                if number:  # join the findings of the blocks before
                    hits = [united(a + b) for a, b in zip(batch.column(len(names)).to_pylist(), hits)]
                    items = [sorted({*a, *b}) for a, b in zip(batch.column(len(names) + 1).to_pylist(), items)]
                if last_block:
                    yield finish(columns, n_words, hits, items)
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], [*names, *both])

        out = out.mapInArrow(run, schema if last_block else between)
        if not last_block:
            before, written = written, Written(out)
            out = written.df
            if before is not None:
                before.drop()
    return out


def scan(bench: Benchmark, hashes: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> dict[int, tuple[list[list[int]], set[int]]]:
    """Findings by document: hit word ranges (united, relative to the document) and items."""
    numbers = bench.numbers_of(*hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    linked = np.zeros(len(numbers) + 1, bool)  # the word and the one before are neighbours in some item
    if len(numbers) > 1 and len(bench.pairs):
        both = np.flatnonzero((numbers[1:] >= 0) & (numbers[:-1] >= 0) & (doc[1:] == doc[:-1]))
        key = numbers[both] * bench.count + numbers[both + 1]
        at = np.minimum(np.searchsorted(bench.pairs, key), len(bench.pairs) - 1)
        linked[both[bench.pairs[at] == key] + 1] = True
    inside = linked[:-1] | linked[1:]
    if bench.single.any():
        inside |= (numbers >= 0) & bench.single[np.maximum(numbers, 0)]
    begins = np.flatnonzero(inside & ~linked[:-1])
    finishes = np.flatnonzero(inside & ~linked[1:]) + 1
    least = min([bench.window, *(n for x in bench.short.values() for n, _ in x)])
    long_enough = finishes - begins >= least
    out: dict[int, tuple[list, set]] = {}
    for a, b in zip(begins[long_enough].tolist(), finishes[long_enough].tolist()):
        hits, items = bench.match(numbers[a:b].tolist())
        if hits:
            k = int(doc[a])
            base = a - int(first[k])
            spans, all_items = out.setdefault(k, ([], set()))
            all_items |= items
            for x, y in sorted(hits):
                x, y = x + base, y + base
                if spans and x <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], y)
                else:
                    spans.append([x, y])
    return out


def united(hits) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and the digest of their ids."""

    def finish(columns, n_words, hits, items):
        n_hit = [sum(b - a for a, b in x) for x in hits]
        arrays = [columns[0], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([sha(",".join(x).encode()) for x in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _streamed(rows, benchmark, window, block_words, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with the hit words cut out of ``text``; a document of which more than ``most_share`` is hit goes.

    A document without hits keeps its text byte for byte; null text stays null. The columns are those of ``docs``.
    """
    names = docs.columns
    at = names.index("text")

    def finish(columns, n_words, hits, _):
        keep = [not x or sum(b - a for a, b in x) <= most_share * n for n, x in zip(n_words, hits)]
        if any(hits):
            texts = columns[at].to_pylist()
            for k, x in enumerate(hits):
                if x and keep[k]:
                    raw = texts[k].encode()
                    _, starts, ends = words_of(raw)
                    out, last = [], 0
                    for a, b in x:
                        out.append(raw[last : starts[a]])
                        last = int(ends[b - 1])
                    texts[k] = b"".join([*out, raw[last:]]).decode()
            columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return _streamed(docs, benchmark, window, block_words, finish, ddl(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
