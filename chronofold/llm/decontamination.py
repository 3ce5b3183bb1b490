"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage by block-max WAND.

Roles are turned round: the few test items are the indexed side, the corpus streams past as queries, and nothing of the
corpus is shuffled but the pairs found. An item's impacts are divided by its score against itself, so a passage that
holds the whole item scores 1 and one threshold serves items of every length. Number of items, mean length and document frequencies are
those of all items, counted by Spark beforehand, so a score never hangs on how the index is cut. Each document is cut into overlapping
windows of words: 2 W words every W, so that each item of up to W words lies whole in some window. Items are indexed by
classes of length, W doubling from class to class.

All windows of some hundred documents get upper bounds at once: the sum, over a window's distinct terms, of the largest
impact in each coarse block of items. Windows with a bound over the threshold run the exact search, block-max WAND over
postings in fine blocks: all items at or over the threshold are retrieved (no top-k), then checked for overlap of word
3-grams with the item's question (all but its last sentence) and its answer (the last sentence).

The index goes to the executors in parts of a checked size (PART items and PART_BYTES of text; an item beyond that is a part of its own).
A larger benchmark takes more passes over the corpus, one after the other: the index of a part is released before the next one is built.

Defined results: null or empty texts match nothing; very long texts are searched whole; items without words are never found; items with
equal texts are found each; an item_id with several texts is found if one of them is; repeated documents give repeated pairs once per
doc_id, and of several windows that retrieve an item the one with the largest least overlap counts, then the largest score (6 places); a null
doc_id is kept as such; an empty table on either side gives an empty result; columns other than doc_id, item_id and text are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import Bounded, arrow, materialize, rows_in, unmaterialize, words_of

K1, B = 1.2, 0.75
#: Share of an item's score against itself.
THRESHOLD = 0.6
#: Share of the question's, and of the answer's, word 3-grams.
OVERLAP = 0.6
LEAST_WIDTH = 64
#: Coarse blocks at most, cells of their table of bounds at most, and items in a fine block.
COARSE, CELLS, FINE = 100, 1 << 23, 8
#: Items, and bytes of their texts, in one part of the index.
PART, PART_BYTES = 50_000, 8_000_000
END = 1 << 60

_EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def term(word: bytes) -> bytes:
    """A word in lower case (A-Z) without ASCII punctuation at its ends; punctuation alone stays as it is."""
    word = word.lower()
    return word.strip(_EDGES) or word


def terms_of(text: str | None) -> list[bytes]:
    return [term(w) for w in words_of(text)]


def grams(terms: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    n = min(n, len(terms))
    return {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Terms of both parts; an item of one sentence is halved."""
    parts = [t for t in map(terms_of, re.split(r"(?<=[.!?])\s+", text)) if t]
    if len(parts) == 1:
        half = len(parts[0]) // 2
        parts = [parts[0][:half] or parts[0], parts[0][half:]]
    return [t for p in parts[:-1] for t in p], parts[-1]


def width_of(n_words: int) -> int:
    """Words of a chunk for items of this length."""
    return LEAST_WIDTH << max(0, math.ceil(math.log2(n_words / LEAST_WIDTH)))


class Statistics:
    """Of all items: their number, their mean length and the document frequencies of (at least) the terms at hand."""

    def __init__(self, n: int, mean: float, df: dict[bytes, int]):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        rows = [t for t in map(terms_of, texts) if t]
        return cls(len(rows), sum(map(len, rows)) / max(1, len(rows)), Counter(t for r in rows for t in set(r)))

    def impacts(self, terms: list[bytes]) -> dict[bytes, float]:
        """Of each term of an item its share of the item's score against itself."""
        norm = K1 * (1 - B + B * len(terms) / self.mean)
        out = {t: math.log(1 + (self.n - self.df[t] + 0.5) / (self.df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(terms).items()}
        own = sum(out.values())
        return {t: x / own for t, x in out.items()}


class Index:
    """Items of one class of length. Items are numbered in order of length, so that those of a block resemble each other."""

    def __init__(self, items: list[tuple[int, str]], width: int, stats: Statistics):
        rows = sorted(((terms_of(t), i, t) for i, t in items), key=lambda r: (len(r[0]), r[1], r[2]))
        self.width, self.ids, n = width, [i for _, i, _ in rows], len(rows)
        self.term_ids: dict[bytes, int] = {}
        lists: list[list[tuple[int, float]]] = []
        self.parts = []  # question and answer of each item as numbers of terms
        for k, (terms, _, text) in enumerate(rows):
            for t, x in stats.impacts(terms).items():
                if (j := self.term_ids.setdefault(t, len(lists))) == len(lists):
                    lists.append([])
                lists[j].append((k, x))
            self.parts.append(tuple(np.array([self.term_ids[t] for t in p], np.int32) for p in question_answer(text)))
        self.items = [[k for k, _ in x] + [END] for x in lists]
        self.impacts = [[w for _, w in x] for x in lists]
        self.most = [max(x) for x in self.impacts]
        #: Of each list, the largest impact in each fine block that it touches.
        self.block_most = [self._blocks(x) for x in lists]
        self.coarse = max(1, -(-n // max(1, min(COARSE, CELLS // len(lists)))))
        self.bounds = np.zeros((len(lists), -(-n // self.coarse)), np.float32)
        for t, x in enumerate(lists):
            for k, w in x:
                self.bounds[t, k // self.coarse] = max(self.bounds[t, k // self.coarse], w)

    @staticmethod
    def _blocks(postings: list[tuple[int, float]]) -> dict[int, float]:
        out: dict[int, float] = {}
        for k, w in postings:
            out[k // FINE] = max(out.get(k // FINE, 0.0), w)
        return out

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items with at least this score for a set of terms, by block-max WAND."""
        least -= 1e-6
        at = [[self.items[t][0], 0, t] for t in terms]
        found = []
        while at:
            at.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(at):
                if c[0] == END:
                    break
                total += self.most[c[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            block = item // FINE
            if sum(self.block_most[c[2]].get(block, 0.0) for c in at[: pivot + 1]) < least:
                # nothing here: on to the block's end, or to where the next list begins
                upto = (block + 1) * FINE
                if pivot + 1 < len(at):
                    upto = min(upto, at[pivot + 1][0])
                for c in at[: pivot + 1]:
                    self._seek(c, max(upto, item + 1))
            elif at[0][0] == item:
                got = 0.0
                for c in at[: pivot + 1]:
                    got += self.impacts[c[2]][c[1]]
                    c[1] += 1
                    c[0] = self.items[c[2]][c[1]]
                if got >= least:
                    found.append((item, got))
            else:
                for c in at[: pivot + 1]:
                    if c[0] < item:
                        self._seek(c, item)
        return found

    def _seek(self, c: list[int], item: int) -> None:
        own = self.items[c[2]]
        while c[0] < item:
            c[1] += 1
            c[0] = own[c[1]]


def indexes(items: list[tuple[int, str]], stats: Statistics) -> list[Index]:
    by_width: dict[int, list[tuple[int, str]]] = {}
    for i, t in items:
        if n := len(words_of(t)):
            by_width.setdefault(width_of(n), []).append((i, t))
    return [Index(x, w, stats) for w, x in sorted(by_width.items())]


class Searcher:
    """Streams texts past one index."""

    def __init__(self, index: Index, least: float):
        self.index, self.least = index, least
        self.known = Bounded(lambda w: index.term_ids.get(term(w), -1))

    def __call__(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float, int]]]:
        """Of each text, by the item's place in the index: best score, overlap of question and answer, windows that retrieved it."""
        index, width = self.index, self.index.width
        words = [words_of(t) for t in texts]
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        # chunks of width words; a window is a chunk and the next one of the same text
        n_chunks = [-(-len(w) // width) for w in words]
        if not sum(n_chunks):
            return out
        text_of = np.repeat(np.arange(len(texts)), n_chunks)
        first = np.cumsum([0, *n_chunks])[:-1]
        get = self.known.__getitem__
        ids = np.concatenate([np.fromiter(map(get, w), np.int64, len(w)) for w in words])
        chunk = np.concatenate([first[k] + np.arange(len(w)) // width for k, w in enumerate(words)])
        hit = ids >= 0
        ids, chunk = ids[hit], chunk[hit]
        n_terms = len(index.term_ids)
        before = (chunk > 0) & (text_of[chunk - 1] == text_of[chunk])
        pairs = np.unique(np.concatenate([chunk * n_terms + ids, (chunk[before] - 1) * n_terms + ids[before]]))
        window, ids = np.divmod(pairs, n_terms)
        if not len(window):
            return out
        starts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        ends = np.append(starts[1:], len(window))
        for k in range(0, len(starts), 4096):
            a, b = starts[k], ends[min(k + 4096, len(ends)) - 1]
            bound = np.add.reduceat(index.bounds[ids[a:b]], starts[k : k + 4096] - a, axis=0).max(1)
            for j in k + np.flatnonzero(bound >= self.least - 1e-4):
                found = index.search(ids[starts[j] : ends[j]].tolist(), self.least)
                if found:
                    t = text_of[window[starts[j]]]
                    lo = (window[starts[j]] - first[t]) * width
                    passage = [self.known[w] for w in words[t][lo : lo + 2 * width]]
                    seen: dict[int, set] = {}
                    for item, score in found:
                        q, r = (self.share(x.tolist(), passage, seen) for x in index.parts[item])
                        old = out[t].get(item, (0.0, 0.0, 0.0, 0))
                        best = max(old[:3], (round(score, 6), q, r), key=lambda x: (min(x[1:]), *x))
                        out[t][item] = (*best, old[3] + 1)
        return out

    @staticmethod
    def share(part: list[int], passage: list[int], seen: dict[int, set]) -> float:
        """Share of the part's distinct 3-grams (of all its words, if it has fewer) that the passage holds. seen: its grams by length."""
        if not part:
            return 0.0
        n = min(3, len(part))
        if n not in seen:
            seen[n] = grams(passage, n)
        own = grams(part, n)
        return len(own & seen[n]) / len(own)


def _parts(docs: DataFrame, items: DataFrame) -> Iterator[Broadcast]:
    """The index, part by part; each is released when the next one is asked for.

    Terms and their frequencies over all items are counted by Spark; to the driver come only the rows of one part and the frequencies of
    its terms, which are no more than its words.
    """
    spark = docs.sparkSession

    def run(batches):
        for ids, texts in rows_in(batches, "item_id", "text", size=200):
            terms = [terms_of(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "n": pa.array(map(len, terms), pa.int64()), "terms": pa.array([sorted(set(t)) for t in terms], pa.list_(pa.binary()))})

    rows = arrow(items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL"), run, "item_id long, text string, n long, terms array<binary>")
    rows = materialize(rows.filter("n > 0"))
    n, words, size, longest = rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if not n:
        return
    df = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    # items beyond PART_BYTES stand alone, the others are dealt out by hash into so many parts that each has half of what it may hold
    k = max(-(-n // PART), -(-size // PART_BYTES))
    k = 1 if k == 1 else 2 * k
    at = F.when(F.octet_length("text") > PART_BYTES, F.concat_ws("-", F.lit("one"), "item_id", F.sha2("text", 256))).otherwise(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)).cast("string"))
    dealt = rows.withColumn("part", at)
    names = [str(j) for j in range(k)] + ([r.part for r in dealt.filter(F.octet_length("text") > PART_BYTES).select("part").distinct().toLocalIterator()] if longest > PART_BYTES else [])
    for name in names:
        own = dealt.filter(F.col("part") == name)
        got = [(r.item_id, r.text) for r in own.select("item_id", "text").collect()]
        if not got:
            continue
        terms = df.join(own.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi") if len(names) > 1 else df
        stats = Statistics(n, words / n, {bytes(r.term): r.df for r in terms.toLocalIterator()})
        shipped = spark.sparkContext.broadcast(indexes(got, stats))
        yield shipped
        if len(names) > 1:
            shipped.destroy()
    unmaterialize(rows)
    unmaterialize(df)


def find(docs: DataFrame, items: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """Pairs retrieved: doc_id, item_id, score, question_overlap, answer_overlap, n_windows and verified (by OVERLAP)."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_windows long"
    found: list[DataFrame] = []
    for shipped in _parts(docs, items):

        def run(batches, shipped=shipped):
            searchers = [Searcher(x, least) for x in shipped.value]
            for ids, texts in rows_in(batches, "doc_id", "text", size=200):
                rows = [(ids[k], s.index.ids[i], *x) for s in searchers for k, got in enumerate(s(texts)) for i, x in got.items()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "n_windows"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        # pairs found are few; written, they need the part's index no more
        found.append(materialize(arrow(docs.select("doc_id", "text"), run, schema)))
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "n_windows"), F.struct(F.least("question_overlap", "answer_overlap"), "score", "question_overlap", "answer_overlap")).alias("x")
    every = reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)
    every = every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")
    return every.withColumn("verified", F.least("question_overlap", "answer_overlap") >= OVERLAP)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The verified pairs of find()."""
    return find(docs, items).filter("verified").drop("verified")


def clean(docs: DataFrame, items: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no verified item. Rows are judged where they are read: no join, no shuffle."""
    schema, rest = docs.schema, docs
    parts = _parts(docs, items)
    shipped = next(parts, None)
    while shipped is not None:

        def run(batches, shipped=shipped):
            searchers = [Searcher(x, least) for x in shipped.value]
            for batch in batches:
                for k in range(0, batch.num_rows, 200):
                    piece = batch.slice(k, 200)
                    texts = piece.column(piece.schema.get_field_index("text")).to_pylist()
                    found = [s(texts) for s in searchers]
                    yield piece.filter(pa.array([not any(min(x[1:3]) >= OVERLAP for f in found for x in f[j].values()) for j in range(len(texts))], pa.bool_()))
                del batch, piece, texts

        before, rest = rest, materialize(arrow(rest, run, schema))
        if before is not docs:
            unmaterialize(before)
        shipped = next(parts, None)
    return rest
