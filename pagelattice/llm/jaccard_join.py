"""Operator 7: n-gram Jaccard join that uses relations between sets.

Method: every distinct set of shingles is one node, known by 96 bits of two hashes and
numbered. Shingles are ordered from rare to common by a fixed-size frequency table over all
documents, and a node is listed under its rarest ones (its prefix), so linked nodes meet in a
list. A list is ordered by size and position, a block for each size: blocks whose size cannot
reach the threshold are skipped as a whole, the others from the position on that cannot, and
a 1024-bit parity map of each set bounds the difference of what is left.

A list of more than ``CHUNK`` entries is dealt in chunks: each two chunks meet in a task of
their own (in the first turns, which only look for near sets, each chunk alone).

Answers are derived from those of highly similar sets: in a list each set is first compared
exactly with the one set that its map is nearest to, and takes over that set's answers if
they link. When those comparisons have joined the sets into components, each set outside a
list's main component is compared with the nearest one of another component. Then the lists
are read again, and a pair is compared only if its sets are not joined already, so that a
group of thousands of near copies is never compared pair by pair. No link between different components is missed: every pair in a
list that passes the bounds is either joined by then or compared.

Defined results: null text, or text without words, has an empty set and links with
nothing; equal sets are linked; repeated rows and rows with one doc_id are each answered;
a null doc_id is answered with its size and the component of the documents with an equal
set (null if there is none), and links no others; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import U64, WORDS_3, Written, fresh, mix, quoted, release, slices, table, text_buffer, text_key, word_hashes, word_spans
from pagelattice.llm.components import connected_components, hot_limit, joined_apart
from pagelattice.llm.substring_dedup import keyed

SHINGLE = 3
THRESHOLD = 90
#: Places of the frequency table: the top bits of a shingle's hash.
TABLE_BITS = 16
MAP_BITS = 1024
#: Turns in which each set proposes the nearest one of another component, before all others are compared.
NEAREST_TURNS = 2
#: Sets with this many shingles have a wide map too.
LARGE = 800
#: Entries of one list that are compared in one task.
CHUNK = 1024
#: Long lists that are named to every task; more are joined by shuffle.
MOST_SENT_KEYS = 200_000
UPPER = np.arange(256, dtype=np.uint8)
UPPER[0x41:0x5B] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of texts, first shingle of each text and the end); a short text is one shingle."""
    data = UPPER[data]
    starts, ends, first = word_spans(data, offsets)
    prefix = WORDS_3.prefix(word_hashes(data, starts, ends, 1)[0])
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(count)), made)
    lo = first[doc] + np.arange(at[-1]) - at[doc]
    hi = np.minimum(lo + width, first[doc + 1])
    return WORDS_3.ranges(prefix, lo, hi) ^ mix((hi - lo).astype(U64)), at


def _table(width: int):
    def run(batches):
        counts = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for i, j in slices(offsets):
                found, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                counts += np.bincount((found >> U64(64 - TABLE_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["place", "n"])

    return run


def frequency_ranks(docs: DataFrame, width: int) -> np.ndarray:
    """Rank of each place of the frequency table, rarest first: 2**TABLE_BITS numbers whatever the corpus."""
    rows = docs.select("text").mapInArrow(_table(width), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << TABLE_BITS, np.int64)
    counts[rows["place"].to_numpy(int)] = rows["n"].to_numpy(int)
    ranks = np.empty(len(counts), U64)
    ranks[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts)).astype(U64)
    return ranks


def ordered_sets(data: np.ndarray, offsets: np.ndarray, width: int, ranks: np.ndarray):
    """For each text its distinct shingles as uint64 that sort from rare to common."""
    found, at = shingles(data, offsets, width)
    shift = U64(64 - TABLE_BITS)
    keys = (ranks[(found >> shift).astype(np.int64)] << shift) | (found & U64((1 << (64 - TABLE_BITS)) - 1))
    for k in range(len(at) - 1):
        yield np.unique(keys[at[k] : at[k + 1]])


def least_common(sizes: np.ndarray | int, percent: int):
    """Shingles that two sets of ``sizes`` in total must share to reach the threshold."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity_map(keys: np.ndarray) -> bytes:
    places = (mix(keys) & U64(MAP_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=MAP_BITS) & 1).astype(np.uint8)).tobytes()


def wide_map(keys: np.ndarray) -> bytes | None:
    """A parity map of twice as many places as shingles, for sets that fill the common map."""
    if len(keys) < LARGE:
        return None
    bits = 1 << (2 * len(keys) - 1).bit_length()
    places = (mix(keys) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the difference of two sets from their wide maps; the larger map is folded onto the smaller."""
    x, y = (np.frombuffer(m, U64) for m in (a, b))
    if len(x) > len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ folded).sum())


LISTED = "kind byte, key long, node long, chk int, n int, pos int, doc_id long, th int, map binary, wide binary"
NAMES = ["kind", "key", "node", "chk", "n", "pos", "doc_id", "th", "map", "wide"]
#: LONG rows name a key and the number of its postings, where those are more than ``CHUNK``.
DOC, POSTING, LONG = 0, 1, 2


def identity(own: np.ndarray) -> tuple[int, int]:
    """96 bits that tell sets apart, from two sums over their elements, each mixed another way."""
    n = np.array([len(own)], U64)
    mixed = mix(own)
    one = mixed.sum(dtype=U64) ^ mix(n)[0]
    two = (mixed * (own ^ (mixed >> U64(29)))).sum(dtype=U64)
    return int(one.view(np.int64)), int((mix(two + n) >> U64(32)).astype(np.uint32).view(np.int32)[0])


def _postings(width: int, percent: int, sent):
    def run(batches):
        ranks = sent.value
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = text_buffer(batch.column(2))
            for i, j in slices(offsets):
                docs, keys, nodes, checks, sizes, places = [], [], [], [], [], []
                known: set[tuple[int, int]] = set()
                for k, own in enumerate(ordered_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, ranks)):
                    n = len(own)
                    node = identity(own)
                    # the row is dealt by document, not by node: a node may stand for a third of all rows
                    docs.append((ids[i + k], node, n, parity_map(own) if node not in known else None, marks[i + k], wide_map(own) if node not in known else None))
                    if n and node not in known:
                        known.add(node)
                        p = prefix_length(n, percent)
                        keys.append(own[:p].view(np.int64))
                        nodes.append(np.full(p, node[0]))
                        checks.append(np.full(p, node[1], np.int32))
                        sizes.append(np.full(p, n, np.int32))
                        places.append(np.arange(p, dtype=np.int32))
                d = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(d, DOC, np.int8)), pa.array([(x[0] or 0) * 0x9E3779B1 % (1 << 62) for x in docs], pa.int64()), pa.array([x[1][0] for x in docs], pa.int64()), pa.array([x[1][1] for x in docs], pa.int32()), pa.array([x[2] for x in docs], pa.int32()), pa.array(np.zeros(d, np.int32)), pa.array([x[0] for x in docs], pa.int64()), pa.array([x[4] for x in docs], pa.int32()), pa.array([x[3] for x in docs], pa.binary()), pa.array([x[5] for x in docs], pa.binary())],
                    NAMES,
                )
                if keys:
                    m = sum(map(len, keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, POSTING, np.int8)), *(pa.array(np.concatenate(x)) for x in (keys, nodes, checks, sizes, places)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())],
                        NAMES,
                    )

    return run


def _long(keys: list[int], counts: list[int]) -> pa.RecordBatch:
    m = len(keys)
    zeros = pa.array(np.zeros(m, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, LONG, np.int8)), pa.array(keys, pa.int64()), pa.array(np.zeros(m, np.int64)), zeros, pa.array(counts, pa.int32()), zeros, *(pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], NAMES)


def _shared(chunk: int):
    """Of rows ordered by (kind, key, node, chk): documents as they are, and postings under keys with several nodes, each
    once; after them the keys with more than ``chunk``."""

    def run(batches):
        carry, count = None, 0  # the last posting, and the nodes of its key so far
        for batch in batches:
            kind = batch.column(0).to_numpy()
            if (kind == DOC).any():
                yield batch.filter(pa.array(kind == DOC))
                batch = batch.filter(pa.array(kind == POSTING))
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            key, node, chk = (batch.column(c).to_numpy() for c in (1, 2, 3))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            once = new.copy()
            once[1:] |= (node[1:] != node[:-1]) | (chk[1:] != chk[:-1])
            group = np.cumsum(new) - 1
            counts = np.bincount(group, once).astype(np.int64)
            passed = count > 1
            if carry is not None:
                counts[0] += count - 1  # the carried row is counted already
            keep = once & (counts > 1)[group]
            if passed:
                keep[0] = False
            if keep.any():
                yield batch.filter(pa.array(keep))
            many = np.flatnonzero(counts[:-1] > chunk)
            if len(many):
                yield _long(key[np.flatnonzero(new)[many]].tolist(), counts[many].tolist())
            # equal (key, node) rows may go on in the next batch; the last one stands for them
            carry, count = batch.slice(len(key) - 1, 1), int(counts[-1])
        if carry is not None and count > chunk:
            yield _long(carry.column(1).to_pylist(), [count])

    return run


def apart(n: np.ndarray, pos: np.ndarray, maps: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """For pairs (i, j) of entries the least difference of their sets by the maps over the largest that links them;
    over 1, and infinite where size or position rules a pair out, it is no link at its first list."""
    a, b = n[i], n[j]
    need = least_common(a + b, percent)
    out = np.full(len(i), np.inf)
    ok = np.flatnonzero((np.minimum(a, b) >= need) & (np.minimum(a - pos[i], b - pos[j]) >= need))
    if len(ok):
        differ = np.bitwise_count(maps[i[ok]] ^ maps[j[ok]]).sum(axis=-1, dtype=np.int64)
        most = (a + b)[ok] - 2 * need[ok]
        out[ok] = np.where(differ <= most, differ / np.maximum(most, 1), np.inf)
    return out


def reachable(i: int, n, pos, place, sizes, starts, percent: int) -> np.ndarray:
    """The entries of a list that may link with entry i by size and position; blocks of other sizes, and what follows
    the last position that can in a block, are skipped. ``place`` is size << 32 | position, in order."""
    a = n[i]
    first, last = np.searchsorted(sizes, -(-percent * a // 100)), np.searchsorted(sizes, 100 * a // percent, "right")
    b = sizes[first:last]
    need = least_common(a + b, percent)
    live = a - pos[i] >= need
    b, need, low = b[live], need[live], starts[first:last][live]
    length = np.searchsorted(place, (b << 32) + (b - need), "right") - low
    length = np.maximum(length, 0)
    return np.repeat(low - (np.cumsum(length) - length), length) + np.arange(length.sum())


def list_pairs(n, pos, maps, comp, percent: int, nearest: bool, side=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one list to compare; entries are ordered by size and position.

    ``nearest``: each entry with the one it seems nearest to. Else every pair of different components that may link;
    with ``side`` only pairs of different sides.
    """
    names, which, count = np.unique(comp, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    left, right = [], []
    main = int(count.argmax())
    place = (n << 32) + pos
    starts = np.flatnonzero(np.diff(n, prepend=-1))
    sizes = n[starts]
    for i in range(len(n)) if len(names) == len(n) else np.flatnonzero(which != main).tolist():
        j = reachable(i, n, pos, place, sizes, starts, percent)
        j = j[which[j] != which[i]]
        if not nearest:
            j = j[(which[j] == main) | (j > i)]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        far = apart(n, pos, maps, np.full(len(j), i), j, percent)
        if nearest:
            best = int(far.argmin())
            if far[best] < np.inf:
                left.append(np.array([i]))
                right.append(j[best : best + 1])
        else:
            j = j[far < np.inf]
            left.append(np.full(len(j), i))
            right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _candidates(percent: int, nearest: bool):
    """Of postings (key, one, two, own, node, n, pos, comp, map) dealt by (key, one, two) and ordered by (key, one, two, n, pos, node):
    pairs of nodes to compare. ``one`` and ``two`` are the chunks of a long list that meet, ``own`` is the entry's."""

    def pairs(batch, begin):
        one, two, own, node, n, pos, comp = (batch.column(c).to_numpy() for c in range(1, 8))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        maps = text_buffer(batch.column(8))[0].view(U64).reshape(len(n), MAP_BITS // 64)
        size = np.diff(np.append(begin, len(n)))
        left, right = [], []
        pair = begin[(size == 2) & (one[begin] == two[begin])]
        if len(pair):
            ok = (apart(n, pos, maps, pair, pair + 1, percent) < np.inf) & (comp[pair] != comp[pair + 1])
            left.append(pair[ok])
            right.append(pair[ok] + 1)
        for b, s in zip(begin.tolist(), size.tolist()):
            e = b + s
            across = one[b] != two[b]
            if s > 2 or across and s > 1:
                x, y = list_pairs(n[b:e], pos[b:e], maps[b:e], comp[b:e], percent, nearest, own[b:e] if across else None)
                left.append(x + b)
                right.append(y + b)
        if not left:
            return None
        x, y = node[np.concatenate(left)], node[np.concatenate(right)]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"]) if len(both) else None

    def run(batches):
        held = []  # the rows of the last list, at most two chunks
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            key, one, two = (batch.column(c).to_numpy() for c in range(3))
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            cut = int(begin[-1])
            if cut:
                out = pairs(batch.slice(0, cut), begin[:-1])
                if out is not None:
                    yield out
            held = [batch.slice(cut)]
        if held:
            out = pairs(held[0], np.zeros(1, np.int64))
            if out is not None:
                yield out

    return run


def _verified(width: int, percent: int):
    """Of pairs with both texts: those whose sets reach the threshold."""

    def run(batches):
        name, held = None, None
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            texts = [text_buffer(batch.column(c)) for c in (2, 3)]
            ok = np.zeros(len(u), bool)
            names = u.to_numpy()

            def own(side, k):
                data, offsets = texts[side]
                part = data[offsets[k] : offsets[k + 1]]
                return np.unique(shingles(part, np.array([0, len(part)]), width)[0])

            for k in range(len(u)):
                if names[k] != name:
                    name, held = names[k], own(0, k)
                other = own(1, k)
                common = len(np.intersect1d(held, other, assume_unique=True))
                ok[k] = 100 * common >= percent * (len(held) + len(other) - common)
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(ok))

    return run


def _not_apart(percent: int):
    """Of pairs (u, v, nu, nv, wu, wv): those that their wide maps, where both have one, leave a chance."""

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            most = n - 2 * least_common(n, percent)
            ok = [a is None or b is None or wide_apart(a, b) <= m for a, b, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _thinned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in ("u", "v")]
    joined = pairs.join(sides[0].hint("merge"), "u").join(sides[1].hint("merge"), "v")
    return joined.select("u", "v", "nu", "nv", "wu", "wv").mapInArrow(_not_apart(percent), "u long, v long")


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> Written:
    """The written pairs whose texts' sets reach the threshold; only texts in some pair are moved."""
    thin = Written(_thinned(pairs, nodes, percent))
    pairs = thin.df
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    texts = Written(_texts(rows, wanted.join(nodes.select("node", "rep"), "node").where("rep is not null")))
    release(rows.sparkSession)
    of = texts.df
    joined = pairs.join(of.select(F.col("node").alias("v"), F.col("text").alias("tv")).hint("merge"), "v").join(of.select(F.col("node").alias("u"), F.col("text").alias("tu")).hint("merge"), "u")
    out = Written(joined.select("u", "v", "tu", "tv").mapInArrow(_verified(width, percent), "u long, v long"))
    texts.drop()
    thin.drop()
    release(rows.sparkSession)
    return out


def _dealt(entries: DataFrame, long: DataFrame, few: bool, chunk: int, nearest: bool) -> DataFrame:
    """Entries (key, one, two, own, node, n, pos, comp, map): those of long lists once for each chunk that theirs meets."""
    of_key = F.broadcast(long) if few else long.hint("merge")
    parts = F.ceil(F.col("entries") / F.lit(chunk)).cast("int")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0))
    out = entries.join(of_key.select("key", parts.alias("parts")), "key", "left").withColumn("own", own)
    meets = F.array("own") if nearest else F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    out = out.withColumn("met", F.explode(meets))
    return out.select("key", F.least("own", "met").alias("one"), F.greatest("own", "met").alias("two"), "own", "node", "n", "pos", "comp", "map")


def jaccard_components(docs: DataFrame, width: int = SHINGLE, percent: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``; see the module for the method."""
    out = classes(docs, width, percent, chunk)
    of = F.when(F.col("n") > 0, F.col("smallest.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), of.alias("component_id"))


def representatives(docs: DataFrame, width: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller (doc_id, text key); all columns as they are.

    Equal rows stay together; rows without words or without doc_id stay.
    """
    found = classes(docs, width, percent).where("n > 0 and doc_id is not null")
    names = fresh(docs.columns, "own_id", "own_key")
    gone = found.where((F.col("doc_id") != F.col("smallest.doc_id")) | (F.col("th") != F.col("smallest.th"))).select(F.col("doc_id").alias(names[0]), F.col("th").alias(names[1])).distinct()
    rows = docs.withColumns({names[0]: F.col("doc_id").cast("long"), names[1]: text_key()})
    return rows.join(gone, names, "left_anti").select(*map(quoted, docs.columns))


def classes(docs: DataFrame, width: int = SHINGLE, percent: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, th, n, smallest) of each row: its text's key, the size of its set, and the smallest (doc_id, th) of its component."""
    rows = keyed(docs)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequency_ranks(rows, width))  # 2**TABLE_BITS numbers
    listed = rows.mapInArrow(_postings(width, percent, sent), LISTED).repartition("key").sortWithinPartitions("kind", "key", "node", "chk").mapInArrow(_shared(chunk), LISTED)
    listed = Written(listed).df
    release(spark)
    ident = ["node", "chk"]
    members = listed.where(F.col("kind") == DOC).select("doc_id", "th", *ident, "n")
    rep = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))
    found = listed.where((F.col("kind") == DOC) & (F.col("n") > 0)).groupBy(*ident).agg(F.min(rep).alias("rep"), F.max("n").alias("n"), F.max("map").alias("map"), F.max("wide").alias("wide"), F.count("*").alias("copies"))
    # the number of a node stands for its 96 bits from here on
    numbered = Written(found.withColumn("id", F.monotonically_increasing_id())).df
    release(spark)
    nodes = numbered.select(F.col("id").alias("node"), "rep", "n", "map", "wide")
    postings = listed.where(F.col("kind") == POSTING).select("key", *ident, "n", "pos")
    long = listed.where(F.col("kind") == LONG).select("key", F.col("n").alias("entries"))
    few = long.count() <= MOST_SENT_KEYS
    shape = "u long, v long"

    def candidates(entries, nearest):
        cut = ["key", "one", "two"]
        dealt = _dealt(entries, long, few, chunk, nearest).repartition(*cut).sortWithinPartitions(*cut, "n", "pos", "node")
        return dealt.mapInArrow(_candidates(percent, nearest), shape).distinct()

    with_maps = postings.join(numbered.select(*ident, "id", "map").hint("merge"), ident).select("key", F.col("id").alias("node"), "n", "pos", "map")
    entries = with_maps.withColumn("comp", F.col("node"))
    tested, links, comps, used = None, None, None, []
    for turn in range(NEAREST_TURNS + 1):
        pairs = candidates(entries, turn < NEAREST_TURNS)
        pairs = Written(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        release(spark)
        found = _links(pairs.df, nodes, rows, width, percent)
        used += [pairs, found]
        if links is None or found.df.limit(1).count():
            links = found.df if links is None else links.union(found.df)
            comps = Written(connected_components(links)).df
        tested = pairs.df if tested is None else tested.union(pairs.df)
        entries = with_maps.join(comps.select("node", "label"), "node", "left").withColumn("comp", F.coalesce("label", "node"))
    for t in used:
        t.drop()
    # the smallest doc_id of each component; a set without links is its own component
    of_node = numbered.select("id", "node", "chk", "copies", "rep").join(comps.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = of_node.groupBy("label").agg(F.min("rep").alias("smallest"), F.count("*").alias("many"))
    limit = hot_limit(members.count())
    of_label = joined_apart(of_node, smallest.select("label", "smallest"), ["label"], "id", smallest.where(F.col("many") > limit).select("label"))
    by_node = of_label.select(*ident, "smallest")
    common = numbered.where(F.col("copies") > limit).select(*ident)
    return joined_apart(members, by_node, ident, "doc_id", common, "left").select("doc_id", "th", "n", "smallest")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, by the document that stands for each."""
    places = wanted.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))
    return rows.join(places.hint("merge"), ["doc_id", "th"]).select("node", "text").dropDuplicates(["node"])


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
