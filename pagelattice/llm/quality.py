"""Operator 10: a quality classifier from an interpolated modified Kneser-Ney model.

Method: the symbols (characters folded by ``fold``; every code point of the trusted documents has
its own) of all trusted documents are counted as n-grams; each task counts its own first, the
counts are summed by n-gram. The tables of counts, continuation counts, contexts and suffixes are
sharded by their keys and joined order by order into the interpolated probability of every n-gram
seen and the back-off weight of every context. A document's perplexity is the mean over its
symbols. A mean over a document hides a short stretch, so two more figures are judged, each by its
worst stretch: the log likelihood of ``TOXIC_WIDTH`` symbols under a second model of the same kind,
of the documents labelled toxic, over that under the first; and the share of ``REPEAT_WIDTH``
symbols whose n-gram stood at most that far before. A document is kept if none of the three
exceeds ``MARGIN`` times its language's quantile over the trusted documents. All code points that no trusted document has are one symbol, never
seen: such symbols are alike to the model.

The tables hold what was seen and grow with the corpus. Up to ``MOST_SENT_GRAMS`` rows they are
sent to the tasks, which look n-grams up where the documents are. Beyond it they stay sharded:
the different n-grams of all documents are joined with them order by order, and each document's
own n-grams, counted first, are joined with the result. Both ways give the same sums.

Trusted: labelled with quality 1 and toxic 0. All of them are used. Their ids are sent to the
tasks up to ``MOST_SENT_IDS``; beyond it documents and labels are joined by shuffle.

Defined results: null text, or text without symbols, has no perplexity and is not kept;
without trusted documents nothing can be judged and everything with symbols is kept; a
fewer than ``LEAST_TOXIC`` toxic documents with text make no second model, and only the other
two figures count; a language without trusted documents (or null) has the quantile over all; rows with one doc_id
share its label and are each answered; an empty table gives an empty result; extra columns
pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import SLICE_BYTES, Written, ddl, fresh, quoted, slices, table, text_buffer

ORDER = 4
QUANTILE = 0.999
#: A document may exceed the quantile by this factor: the mean over the few symbols of a short text scatters widely.
MARGIN = 1.3
TOXIC_WIDTH = 12
REPEAT_WIDTH = 40
LEAST_TOXIC = 20
MOST_SENT_IDS = 1_000_000
#: Languages whose limits are sent to the tasks; more are joined by shuffle.
MOST_SENT_LANGUAGES = 100_000
#: Rows of all tables of a model that is sent to the tasks, at most 24 bytes each.
MOST_SENT_GRAMS = 2_000_000
#: Different n-grams that a task holds while it counts; more are passed on in parts.
MOST_HELD_GRAMS = 1_000_000


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text of each): lower case, every digit 0, white space and control characters one blank in a row."""
    low = [t.lower() for t in texts]
    joined = "".join([x + "\n" for x in low])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(low)), [len(x) + 1 for x in low])
    codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
    blank = (codes <= 32) | ((codes >= 0x7F) & (codes <= 0xA0)) | ((codes >= 0x2000) & (codes <= 0x200B)) | (codes == 0x3000)
    codes = np.where(blank, 32, codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~blank[1:] | ~blank[:-1] | (owner[1:] != owner[:-1])
    first = np.ones(len(codes), bool)
    first[1:] = owner[1:] != owner[:-1]
    keep &= ~(first & blank)  # no blank before a text; each has one after it, if anything
    return codes[keep], owner[keep]


@dataclass
class Alphabet:
    """Number of each code point: 0 begins a text, 1 is anything that has no number of its own."""

    points: np.ndarray

    @cached_property
    def table(self) -> np.ndarray:
        table = np.ones(0x110000, np.int32)
        table[self.points] = np.arange(2, 2 + len(self.points))
        return table

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        return self.table[codes]


def batches_of(column, most: int = SLICE_BYTES // 2):
    _, offsets = text_buffer(column)
    for i, j in slices(offsets, most):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


def grams(symbols: np.ndarray, owner: np.ndarray, order: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of the n-gram that ends at each symbol; before a text stand symbols 0.

    A context is a number in base ``size``, the last symbol last: three symbols of any alphabet fit 63 bits.
    """
    context = np.zeros(len(symbols), np.int64)
    for k in range(1, order):
        if len(symbols) > k:
            same = owner[k:] == owner[:-k]
            context[k:] += np.where(same, symbols[:-k], 0).astype(np.int64) * size ** (k - 1)
    return context, symbols.astype(np.int64)


def distinct(context: np.ndarray, symbol: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the different n-grams of each, their contexts, their symbols)."""
    of, contexts = pd.factorize(context)
    place, pairs = pd.factorize(of * size + symbol)
    return place, contexts[pairs // size], pairs % size


def _point_counts(batches):
    counts = np.zeros(0x110000, np.int64)
    for batch in batches:
        for _, _, texts in batches_of(batch.column(0)):
            codes, _ = fold(texts)
            found, n = np.unique(codes, return_counts=True)
            counts[found] += n
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["point", "n"])


def fit_alphabet(texts: DataFrame, size: int | None = None) -> Alphabet:
    """All code points of the trusted texts; with ``size`` the most frequent ``size - 2``, ties to the smaller."""
    found = texts.mapInArrow(_point_counts, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    if size is not None:
        found = found.orderBy(F.desc("n"), "point").limit(size - 2)
    return Alphabet(np.sort(found.select("point").toArrow()["point"].to_numpy().astype(np.int64)))


def count_table(texts: DataFrame, alphabet: Alphabet, order: int, size: int) -> DataFrame:
    """(context, symbol, c): how often each n-gram of the highest order occurs; every task adds up its own first."""
    sent = texts.sparkSession.sparkContext.broadcast(alphabet.points)

    def summed(parts):
        context, symbol, n = (np.concatenate(x) for x in zip(*parts))
        place, context, symbol = distinct(context, symbol, size)
        return context, symbol, np.bincount(place, n, minlength=len(context)).astype(np.int64)

    def rows(parts):
        context, symbol, n = summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(context), pa.array(symbol.astype(np.int32)), pa.array(n)], ["context", "symbol", "c"])

    def run(batches):
        own = Alphabet(sent.value)
        held, waiting = [], 0
        for batch in batches:
            for _, _, part in batches_of(batch.column(0)):
                codes, owner = fold(part)
                place, context, symbol = distinct(*grams(own.numbers(codes), owner, order, size), size)
                held.append((context, symbol, np.bincount(place, minlength=len(context))))
                waiting += len(context)
                if waiting > MOST_HELD_GRAMS:
                    held = [summed(held)]
                    waiting = 0
                    if len(held[0][0]) > MOST_HELD_GRAMS:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)

    return texts.mapInArrow(run, "context long, symbol int, c long").groupBy("context", "symbol").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def probability_tables(counts: DataFrame, order: int, size: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """By order: (context, symbol, p) of every n-gram seen, and (context, back) of every context seen.

    The suffix of an n-gram has the same symbol and the context without its first symbol. Lower orders
    count the different symbols that stand before.
    """
    tables = [Written(counts)]  # each is made from the one written before it: the texts are counted once
    for k in range(order - 1, 0, -1):
        tables.append(Written(tables[-1].df.groupBy((F.col("context") % F.lit(size ** (k - 1))).alias("context"), "symbol").agg(F.count("*").alias("c"))))
    tables.reverse()
    probabilities, backs = [], []
    for k, t in enumerate(tables, 1):
        d1, d2, d3 = discounts(t.df)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = t.df.groupBy("context").agg(F.sum("c").alias("total"), F.sum(discount).alias("mass"))
        context = context.select("context", "total", (F.col("mass") / F.col("total")).alias("back"))
        joined = t.df.join(context, "context")
        lower = F.lit(1.0 / size) if k == 1 else F.col("lower")
        if k > 1:
            below = probabilities[-1].select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("lower"))
            joined = joined.withColumn("suffix", F.col("context") % F.lit(size ** (k - 2))).join(below, ["suffix", "symbol"])
        made = joined.select("context", "symbol", ((F.col("c") - discount) / F.col("total") + F.col("back") * lower).alias("p"))
        probabilities.append(Written(made).df)
        backs.append(Written(context.select("context", "back")).df)
    return probabilities, backs


@dataclass
class Level:
    """One order of a model that is sent: contexts, sorted, and the n-grams as context's place * size + symbol, sorted."""

    contexts: np.ndarray
    backs: np.ndarray
    pairs: np.ndarray
    logs: np.ndarray


def level(probabilities: DataFrame, backs: DataFrame, size: int) -> Level:
    b, p = backs.toArrow(), probabilities.toArrow()
    contexts, back = b["context"].to_numpy(), b["back"].to_numpy()
    by = np.argsort(contexts)
    contexts = contexts[by]
    pairs = np.searchsorted(contexts, p["context"].to_numpy()) * size + p["symbol"].to_numpy()
    order = np.argsort(pairs)
    return Level(contexts, np.log(back[by]).astype(np.float32), pairs[order], np.log(p["p"].to_numpy()[order]).astype(np.float32))


def find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each number in a sorted list."""
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


@dataclass
class Model:
    """``levels`` hold a model that is sent; a larger one has None there and stays in its tables."""

    alphabet: Alphabet
    order: int
    size: int
    levels: list[Level] | None
    tables: tuple[list[DataFrame], list[DataFrame]] | None = None
    toxic: Model | None = None
    held: object = None

    def sent(self, spark: SparkSession):
        """The model on every executor, sent once."""
        if self.held is None:
            self.held = spark.sparkContext.broadcast((self.alphabet.points, self.order, self.size, self.levels, self.toxic and self.toxic.levels))
        return self.held

    def log_probabilities(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """An n-gram that was not seen has its context's weight times its suffix; a context that was not seen weighs 1."""
        out = np.zeros(len(context))
        left = np.arange(len(context))
        for k in range(self.order, 0, -1):
            now = self.levels[k - 1]
            at, seen = find(now.contexts, context[left] % self.size ** (k - 1))
            pair, hit = find(now.pairs, at * self.size + symbol[left])
            hit &= seen
            out[left[hit]] += now.logs[pair[hit]]
            out[left[seen & ~hit]] += now.backs[at[seen & ~hit]]
            left = left[~hit]
        out[left] -= np.log(self.size)
        return out

    @property
    def logs(self) -> np.ndarray:
        """The log probability of every possible n-gram, by number: for small models only."""
        every = np.arange(self.size**self.order)
        return self.log_probabilities(every // self.size, every % self.size)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sum of log probabilities) of each text."""
        codes, owner = fold(texts)
        if not len(codes):
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        place, context, symbol = distinct(*grams(self.alphabet.numbers(codes), owner, self.order, self.size), self.size)
        n = np.bincount(owner, minlength=len(texts))
        return n, np.bincount(owner, self.log_probabilities(context, symbol)[place], minlength=len(texts))


def stretch(values: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """The largest sum of ``width`` values that follow each other, or of fewer at its beginning, in each text that has some."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    begin = np.repeat(first, np.diff(first, append=len(owner)))
    sums = np.concatenate([[0.0], np.cumsum(values)])
    at = np.arange(len(owner))
    return np.maximum.reduceat(sums[1:] - sums[np.maximum(at - width + 1, begin)], first)


def repeats(place: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Whether the n-gram of each symbol ended at one of the ``width`` symbols before it too, in the same text."""
    by = np.argsort(place, kind="stable")
    out = np.zeros(len(place), bool)
    out[by[1:]] = (place[by[1:]] == place[by[:-1]]) & (owner[by[1:]] == owner[by[:-1]]) & (by[1:] - by[:-1] <= width)
    return out


#: What ``figures`` gives of each text; as columns beside others they may get other names (``figure_names``).
FIGURES = ["n_symbols", "perplexity", "toxic_stretch", "repeat_stretch"]


def figure_names(docs: DataFrame) -> list[str]:
    return fresh(docs.columns, *FIGURES)


def figures(texts: list[str], alphabet: Alphabet, order: int, size: int, logs_of) -> list[pa.Array]:
    """``FIGURES`` of each text; ``logs_of`` has (log, toxic log or None) of different n-grams."""
    n, total, toxic, repeat = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    codes, owner = fold(texts)
    second = None
    if len(codes):
        place, context, symbol = distinct(*grams(alphabet.numbers(codes), owner, order, size), size)
        first, second = logs_of(context, symbol)
        n, total = np.bincount(owner, minlength=len(texts)), np.bincount(owner, first[place], minlength=len(texts))
        if second is not None:
            toxic[n > 0] = stretch((second - first)[place], owner, TOXIC_WIDTH)
        repeat[n > 0] = stretch(repeats(place, owner, REPEAT_WIDTH), owner, REPEAT_WIDTH) / REPEAT_WIDTH
    none = n == 0
    return [pa.array(n.astype(np.int64)), pa.array(np.exp(-total / np.maximum(n, 1)), mask=none), pa.array(toxic, mask=none | (second is None)), pa.array(repeat, mask=none)]


def train(texts: DataFrame, order: int = ORDER, size: int | None = None, most_sent: int | None = None, toxic: DataFrame | None = None) -> Model | None:
    """A model of the column ``text``, with one of ``toxic`` over the same alphabet; None if there is nothing to learn from."""
    texts = texts.select("text").where("text is not null")
    alphabet = fit_alphabet(texts, size)
    if not len(alphabet.points):
        return None
    size = len(alphabet.points) + 2 if size is None else size
    both = [probability_tables(count_table(t, alphabet, order, size), order, size) for t in (texts, toxic) if t is not None]
    small = sum(t.count() for tables in both for side in tables for t in side) <= (MOST_SENT_GRAMS if most_sent is None else most_sent)
    made = [Model(alphabet, order, size, [level(p, b, size) for p, b in zip(*tables)] if small else None, tables) for tables in both]
    made[0].toxic = made[1] if len(made) > 1 else None
    return made[0]


def labelled_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """The texts of documents labelled toxic, if they are enough to learn from."""
    ids = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    sent = F.broadcast(ids) if ids.count() <= MOST_SENT_IDS else ids.hint("merge")
    found = docs.join(sent, "doc_id", "left_semi").select("text").where("trim(text) != ''")
    return found if found.limit(LEAST_TOXIC).count() == LEAST_TOXIC else None


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is labelled with quality 1 and toxic 0, and never otherwise."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)).alias("good")).where("good = 1 and doc_id is not null").select("doc_id")
    sent = F.broadcast(good) if good.count() <= MOST_SENT_IDS else good.hint("merge")
    return docs.join(sent, "doc_id", "left_semi").select(*docs.columns)


def document_grams(rows: DataFrame, model: Model) -> DataFrame:
    """(row_, context, symbol, n): the different n-grams of each document with their counts."""
    order, size = model.order, model.size
    sent = rows.sparkSession.sparkContext.broadcast(model.alphabet.points)

    def run(batches):
        own = Alphabet(sent.value)
        for batch in batches:
            for i, _, texts in batches_of(batch.column(1)):
                codes, owner = fold(texts)
                place, context, symbol = distinct(*grams(own.numbers(codes), owner, order, size), size)
                if not len(place):
                    continue
                pairs, n = np.unique(owner * len(context) + place, return_counts=True)
                of, gram = pairs // len(context), pairs % len(context)
                ids = batch.column(0).take(pa.array(of + i))
                yield pa.RecordBatch.from_arrays([ids, pa.array(context[gram]), pa.array(symbol[gram].astype(np.int32)), pa.array(n)], ["row_", "context", "symbol", "n"])

    return rows.select("row_", "text").mapInArrow(run, "row_ long, context long, symbol int, n long")


def joined_logs(asked: DataFrame, model: Model) -> DataFrame:
    """(context, symbol, log) of the n-grams asked for, from the sharded tables: as ``Model.log_probabilities``."""
    probabilities, backs = model.tables
    out = asked.withColumns({"log": F.lit(None).cast("double"), "weight": F.lit(0.0)})
    for k in range(model.order, 0, -1):
        # the lowest tables have a row for each symbol at most and few keys for many rows
        near = F.broadcast if k <= 2 else lambda t: t
        p = probabilities[k - 1].select(F.col("context").alias("own"), "symbol", F.log("p").alias("p_"))
        b = backs[k - 1].select(F.col("context").alias("own"), F.log("back").alias("b_"))
        out = out.withColumn("own", F.col("context") % F.lit(model.size ** (k - 1)))
        out = out.join(near(p) if k == 1 else p, ["own", "symbol"], "left").join(near(b), "own", "left")
        out = out.select("context", "symbol", F.coalesce("log", F.col("weight") + F.col("p_")).alias("log"), (F.col("weight") + F.coalesce("b_", F.lit(0.0))).alias("weight"))
    return out.select("context", "symbol", F.coalesce("log", F.col("weight") - F.log(F.lit(float(model.size)))).alias("log"))


def scored_by_join(docs: DataFrame, model: Model) -> DataFrame:
    """As ``scored``: each document is joined with the log probabilities of its own n-grams."""
    mark, known_logs = fresh(docs.columns, "row_", "logs_")
    rows = Written(docs.withColumn(mark, F.monotonically_increasing_id())).df
    own = Written(document_grams(rows.select(F.col(mark).alias("row_"), "text"), model)).df
    asked = Written(own.select("context", "symbol").distinct()).df
    logs = joined_logs(asked, model).withColumnRenamed("log", "first")
    if model.toxic is not None:
        logs = logs.join(joined_logs(asked, model.toxic).withColumnRenamed("log", "second"), ["context", "symbol"])
    else:
        logs = logs.withColumn("second", F.lit(None).cast("double"))
    lists = own.join(logs, ["context", "symbol"]).groupBy(F.col("row_").alias(mark)).agg(F.collect_list(F.struct("context", "symbol", "first", "second")).alias(known_logs))
    order, size, has = model.order, model.size, model.toxic is not None
    sent = docs.sparkSession.sparkContext.broadcast(model.alphabet.points)
    names, added = docs.columns, figure_names(docs)
    at = names.index("text")

    def run(batches):
        alphabet = Alphabet(sent.value)
        for batch in batches:
            found = []
            for text, held in zip(batch.column(at), batch.column(len(names))):
                known = held.values

                def logs_of(context, symbol, known=known):
                    # both lists have the same different n-grams
                    theirs = np.lexsort((known.field("symbol").to_numpy(), known.field("context").to_numpy()))
                    place = np.empty(len(context), np.int64)
                    place[np.lexsort((symbol, context))] = theirs
                    return known.field("first").to_numpy()[place], known.field("second").to_numpy()[place] if has else None

                found.append(figures([text.as_py() or ""], alphabet, order, size, logs_of))
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.concat_arrays(x) for x in zip(*found))], [*names, *added])

    return rows.join(lists, mark, "left").select(*map(quoted, names), known_logs).mapInArrow(run, scored_schema(docs))


def scored_schema(docs: DataFrame) -> str:
    return ddl(docs, *(f"{n} {t}" for n, t in zip(figure_names(docs), ("long", "double", "double", "double"))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``FIGURES``: symbols, perplexity and the two worst stretches (null without symbols or a model)."""
    if model.levels is None:
        return scored_by_join(docs, model)
    at, added = docs.columns.index("text"), figure_names(docs)
    sent = model.sent(docs.sparkSession)

    def run(batches):
        points, order, size, levels, second = sent.value
        own = Model(Alphabet(points), order, size, levels)
        toxic = second and Model(own.alphabet, order, size, second)

        def logs_of(context, symbol):
            return own.log_probabilities(context, symbol), toxic and toxic.log_probabilities(context, symbol)

        for batch in batches:
            found = [figures(texts, own.alphabet, order, size, logs_of) for _, _, texts in batches_of(batch.column(at))]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.concat_arrays(x) for x in zip(*found))], [*batch.schema.names, *added])

    return docs.mapInArrow(run, scored_schema(docs))


def language_limits(good: DataFrame, quantile: float) -> DataFrame:
    """(lang, limits...) from the figures of trusted documents: ``MARGIN`` times the quantile of each, one row for each
    language and one without language for all others."""

    def asked(x):
        limit = F.percentile_approx(x, quantile, 10_000)
        return ((F.greatest(limit, F.lit(0.0)) if x == FIGURES[2] else limit) * MARGIN).alias(x)

    overall = good.agg(*map(asked, FIGURES[1:])).withColumn("lang", F.lit(None).cast("string"))
    by_lang = good.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg(*map(asked, FIGURES[1:]))
    return by_lang.unionByName(overall)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, size: int | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` with ``FIGURES``, the limit of the perplexity and whether each is kept; and the names of those columns."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    good = trusted(known, labels)
    model = train(good, order, size, toxic=labelled_toxic(known, labels))
    names = fresh(docs.columns, *FIGURES, "threshold", "keep")
    n, figure, limit, keep = names[0], names[1:4], names[4], names[5]
    none = F.lit(None).cast("double")
    if model is None:
        has = F.length(F.trim(F.coalesce(F.col("text"), F.lit("")))) > 0
        return docs.withColumns({n: F.length("text").cast("long"), **{x: none for x in (*figure, limit)}, keep: has}), names
    judged_by = Written(scored(good, model).select("lang", *FIGURES[1:]).where(F.col(FIGURES[1]).isNotNull()))
    limits = Written(language_limits(judged_by.df, quantile)).df
    judged_by.drop()
    overall = limits.where("lang is null").first()
    own = fresh([*docs.columns, *names], "own_lang", *(f"{x}_limit" for x in FIGURES[1:]))
    of_lang = limits.where("lang is not null").select("lang", *FIGURES[1:]).toDF(*own)
    of_lang = F.broadcast(of_lang) if of_lang.count() <= MOST_SENT_LANGUAGES else of_lang.hint("merge")
    out = scored(docs, model).join(of_lang, F.col("lang").cast("string") == F.col(own[0]), "left")
    limit_of = [F.coalesce(F.col(o), F.lit(float("inf") if overall[x] is None else overall[x])) for o, x in zip(own[1:], FIGURES[1:])]
    perplexity, toxic, repeat = (F.col(f) <= at for f, at in zip(figure, limit_of))
    fine = perplexity & repeat & F.coalesce(toxic, F.lit(True))
    return out.withColumns({limit: limit_of[0], keep: F.coalesce(fine, F.lit(False))}).drop(*own), names


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    out, names = judged(docs, labels, quantile)
    return out.where(F.col(names[5])).select(*map(quoted, docs.columns))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    out, _ = judged(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "keep")
