"""Operator 3: byte-level BPE encoding and decoding.

Method: the symbols of one pre-token form a doubly linked list; a priority queue holds
the merge ranks of neighbouring symbols and an entry whose symbols have changed since
is skipped as stale. Decoding concatenates the strings of the vocabulary.

Defined results: null text counts as empty (no tokens, empty text); rows are encoded
one by one, so repeated rows give repeated results; an empty table gives an empty
result; columns other than the text are never read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import table

#: The published split pattern of byte-level BPE (a fixed value); white space is Unicode's, not Python's.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ID_BITS = 24
#: White space followed by a space, and the places before a space that follows anything else.
AMID_SPACE, CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
#: Chunks, and pre-tokens, whose encoding a worker keeps; a full store becomes the old one, and the old one goes.
KEPT = 200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Vocabulary:
    """Vocabulary, merge ranks and special tokens of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.letters = byte_letters()
        back = {c: b for b, c in self.letters.items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in s if c in back) for s, i in self.ids.items()}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        #: left id << ID_BITS | right id -> rank; and the id that a rank makes
        self.merges: dict[int, int] = {}
        self.made_by: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a] << ID_BITS | self.ids[b]] = rank
            self.made_by.append(self.ids[a + b])
        self.byte_ids = [self.ids[self.letters[b]] for b in range(256)]
        self.byte_ranks = [self.merges.get(x << ID_BITS | y, -1) for x in self.byte_ids for y in self.byte_ids]
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        if max(self.bytes_of) > 0xFFFF:
            raise ValueError("ids beyond 65535 don't fit into two bytes")
        self.said = [f"{i}," for i in range(max(self.bytes_of) + 1)]
        self.kept = KEPT
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def merge(self, text: bytes) -> list[int]:
        """The ids of one pre-token: lowest rank first, leftmost first among equals.

        ``rank_at`` holds the rank of each symbol with the one after it; a queue entry
        ``rank << places | place`` is stale if that has changed.
        """
        n = len(text)
        symbols = [self.byte_ids[b] for b in text]
        if n < 2:
            return symbols
        get, made_by = self.merges.get, self.made_by
        places = max(16, n.bit_length())
        pair = self.byte_ranks
        rank_at = [pair[x << 8 | y] for x, y in zip(text, text[1:])]
        rank_at.append(-1)
        queue = [r << places | i for i, r in enumerate(rank_at) if r >= 0]
        if not queue:
            return symbols
        heapify(queue)
        here = (1 << places) - 1
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            top = heappop(queue)
            i = top & here
            rank = top >> places
            if rank_at[i] != rank:
                continue  # stale
            j = after[i]
            symbols[i] = made = made_by[rank]
            symbols[j] = rank_at[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                rank_at[i] = rank = get(made << ID_BITS | symbols[k], -1)
                if rank >= 0:
                    heappush(queue, rank << places | i)
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                rank_at[h] = rank = get(symbols[h] << ID_BITS | made, -1)
                if rank >= 0:
                    heappush(queue, rank << places | h)
        return [s for s in symbols if s >= 0]

    def pre_token(self, text: str) -> bytes:
        """The ids of one pre-token, packed."""
        found = self.words.get(text)
        if found is not None:
            return found
        found = self.old_words.get(text)
        if found is None:
            found = array("H", self.merge(text.encode())).tobytes()
            if len(text) > 48:
                return found
        if len(self.words) >= self.kept:
            self.old_words = self.words
            self.words = {}
        self.words[text] = found
        return found

    def chunk(self, text: str) -> bytes:
        """The packed ids of a text without special tokens."""
        return b"".join([self.pre_token(t) for t in self.split.findall(text)])

    def after_space(self, text: str) -> bytes:
        found = self.known.get(text) or self.old.get(text)
        if found is None:
            if text.isalpha():
                return self.pre_token(" " + text) if len(text) > 48 else self.keep(text, self.pre_token(" " + text))
            if text[-1:] in (",", ".") and text[:-1].isalpha():
                found = self.pre_token(" " + text[:-1]) + self.pre_token(text[-1])
            else:
                found = self.chunk(" " + text)
            if len(text) > 48:
                return found
        return self.keep(text, found)

    def keep(self, text: str, found: bytes) -> bytes:
        if len(self.known) >= self.kept:
            self.old = self.known
            self.known = {}
        self.known[text] = found
        return found

    def ordinary(self, text: str) -> list[bytes]:
        """The packed ids of the chunks of a text without special tokens.

        A space that follows a character other than white space always begins a pre-token,
        so the text may be cut there and each chunk looked up as a whole.
        """
        if AMID_SPACE.search(text):
            first, *rest = CUT.split(text)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
        get, make = self.known.get, self.after_space
        out = [get(x) or make(x) for x in rest]
        if first:
            out.insert(0, self.chunk(first))
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text, two bytes each."""
        out, start = [], 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            out += self.ordinary(text[start : m.start()])
            out.append(array("H", [self.special[m[0]]]).tobytes())
            start = m.end()
        return b"".join(out + self.ordinary(text[start:] if start else text))

    def encode(self, text: str) -> list[int]:
        return array("H", self.packed(text)).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of ``docs`` with an array column of token ids (empty for null text)."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def run(texts):
        v = vocabulary(path)
        return texts.map(lambda t: v.encode(t or ""))

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of ``docs`` with the text of their token ids (empty for null)."""
    path = path or default_path()

    @F.pandas_udf("string")
    def run(rows):
        v = vocabulary(path)
        return rows.map(lambda x: v.decode(list(x)) if x is not None else "")

    return docs.withColumn(text, run(F.col(ids)))


def digest(docs: DataFrame, path: str | None = None, kept: int = KEPT) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the decoded text.

    One pass without a shuffle. A worker keeps the encodings of at most ``2 * kept`` short chunks, and as many pre-tokens.
    """
    path = path or default_path()

    def run(batches):
        v = vocabulary(path)
        v.kept = kept
        gc.collect()
        gc.freeze()  # the vocabulary and the stores hold no cycles; looking through them again and again takes a tenth of the time
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = v.encode(t) if t else []
                said, back = v.said, v.bytes_of
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256("".join([said[i] for i in ids])[:-1].encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join([back[i] for i in ids]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
