"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and their components.

A size-aware heavy-light join. Equal sets fall into classes first; all else happens between class representatives.

* Light sets (up to a size chosen by cost) meet each other by their subsets of the fixed sizes c at which they can have a partner:
  two sets of sizes s and t link exactly if they share a subset of c(s, t) = ceil(0.8 (s + t) / 1.8) shingles. In a group
  that shares a subset, every link is implied by links to the smallest set, so a star of candidates is enough.
* Heavy sets are found by scanning inverted lists. A set needs to be in the lists of its n - ceil(0.8 n) + 1 first
  shingles only, in an order common to all documents: least frequent first. Frequencies come from a count sketch over all
  shingles of all documents, of fixed size, summed up by a tree of tasks; its errors may lengthen lists but cannot lose a link, since any
  common order is right. Light sets large enough for a heavy partner stand in the lists too, and a list without a heavy member is
  dropped: pairs of light sets are left to the subsets.

The boundary is the size at which subsets to make and list postings to scan, together, cost least. Numbers of subsets are exact; the
length of each list that a small set would stand in comes from the sketch. Sizes beyond MOST need no look: there a set's subsets outnumber
its postings times 2.5e11 documents.

Lists may be long (thousands of near copies), so pairs are never emitted: the members of a list become a star around its
smallest one (its hub), linear in the postings. Members of a hub are dealt into blocks of at most BLOCK. Members that by their sizes and
small bitmaps can link with nobody in their block are left out; the others, with their texts, are checked block by block, all
pairs of a block at once, exactly, and only a spanning forest of the links is emitted. Where a hub has several blocks, members outside the
hub's largest component then meet every other block, again by bitmaps first and by texts only where those leave a chance. So no pair of a
list goes unchecked unless its ends are already connected. Components come from rounds of large-star and small-star steps over the
forest's edges, whose tables are cut off in the shared folder. Joins on a key that may be hot (a very common text, a hub, the root of a large
component) have one row a key on one side, so that adaptive execution can split the other.

Sets are compared as sets of 64-bit shingle hashes; classes as 128-bit digests. Two sets of n shingles each have a wrong shingle in common
with a chance of n * n / 2^64: 5e-14 for texts of a thousand words; and for a wrong link, as many as the bound still lacks must meet.

Defined results: a null or empty text has no shingles and is linked with nothing; a text of fewer than 5 words has one; very long texts
count whole; ties and repeated rows are copies; rows with a null doc_id get the component of their text's class (null if it has no other); of
rows that share a doc_id but not the text, each is judged by its own text; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm._common import arrow, materialize, rows_in, unmaterialize

N = 5
#: Similarity in percent.
PERCENT = 80
#: Counters of the sketch, and into how many rows it is cut.
SKETCH, PARTS = 1 << 21, 64
#: Sketches that one task sums up.
FAN = 64
#: Least and most bits of the filter over the ids of documents whose texts are fetched (half a megabyte to 32).
FILTER = (1 << 22, 1 << 28)
#: Sets that are checked against each other at once.
BLOCK = 512
#: Least and most bits of the bitmaps by which members of a list are compared before their texts are fetched.
BITS = (1024, 1 << 17)
#: Sets up to this size may be light. Comparing two bitmaps costs so much of what making a subset costs.
MOST, COMPARE = 64, 0.1

_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors: powers of the golden ratio's.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, N + 1)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array per text. A shingle is the mixed sum of its words' hashes, each times a factor of its place."""
        if not texts:
            return []
        words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
        h = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) for w in words])
        full = np.zeros(max(0, len(h) - N + 1), np.uint64)
        for k in range(N):
            full += h[k : len(full) + k] * _FACTORS[k]
        full, out, at = _mix(full), [], 0
        for w in words:
            n = min(N, len(w))
            if n == N:
                x = np.sort(full[at : at + len(w) - N + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            else:
                out.append(_mix((h[at : at + n] * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))[: 1 if n else 0])
            at += len(w)
        return out


def least_overlap(s: int, t: int) -> int:
    """Shingles that sets of these sizes share if they link."""
    return -(-PERCENT * (s + t) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


@lru_cache(maxsize=64)
def subset_sizes(n: int) -> tuple[int, ...]:
    """Sizes of the subsets at which a light set of size n can meet any partner."""
    partners = range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)
    return tuple(sorted({c for t in partners if (c := least_overlap(n, t)) <= min(n, t)}))


def n_subsets(n: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n))


def meets_heavy(n: int, light: int) -> bool:
    """Whether a set of this size may link with one of more than light shingles."""
    return 100 * n >= PERCENT * max(n, light + 1)


def choose_boundary(costs: dict[int, tuple[int, float]]) -> int:
    """The largest size of light sets. costs: by size, the number of sets and what scanning their lists costs, all told."""

    def cost(x: int) -> float:
        return sum((k * n_subsets(n) if n <= x else 0) + (lists if meets_heavy(n, x) else 0) for n, (k, lists) in costs.items())

    return min(range(MOST + 1), key=cost)


def prefix(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The shingles in whose lists a set stands: the least frequent ones. s is sorted, so ties go by hash."""
    return s[np.argsort(level_of(s, level), kind="stable")[: prefix_length(len(s))]]


def signatures(s: np.ndarray, level: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of inverted lists and keys of subsets of one set."""
    none = np.empty(0, np.uint64)
    first = prefix(s, level) if meets_heavy(len(s), light) else none
    if len(s) > light:
        return first, none
    subs = [_fold(np.array(x, np.uint64), c) for c in subset_sizes(len(s)) for x in combinations(s.tolist(), c)]
    return first, np.array(subs, np.uint64)


def _fold(x: np.ndarray, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")


def _sets(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n, digest and, of small sets, the shingles; besides, rows with task, part and counts: the sketch of each task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("small", pa.binary()), ("task", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        shingle, sketch, task = Shingler(), np.zeros(SKETCH, np.int64), TaskContext.get().partitionId()
        for ids, texts in rows_in(batches, "doc_id", "text", size=200):
            sets = shingle(texts)
            np.add.at(sketch, (np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64), 1)
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            small = [s.tobytes() if 0 < len(s) <= MOST else None for s in sets]
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(small, pa.binary()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        rows = [(k, zlib.compress(c.astype("<u8").tobytes(), 1)) for k, c in enumerate(np.split(sketch, PARTS)) if c.any()]
        none = pa.nulls(len(rows))
        yield pa.RecordBatch.from_arrays([*[none.cast(pa.int64())] * 4, none.cast(pa.binary()), pa.array([task] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], schema=schema)

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, hi long, lo long, small binary, task long, part int, counts binary")


def _levels(sketches: DataFrame) -> np.ndarray:
    """Twice the logarithm of each counter's sum: SKETCH bytes, whatever the input.

    Sums go up a tree, FAN sketches to a task, so that no task gets more than FAN of them, however many tasks read the corpus.
    """

    def run(batches):
        # rows come in order of task and part: one sum is held at a time
        key, total = None, None
        done = lambda: pa.RecordBatch.from_pydict({"task": pa.array([key[0]], pa.int64()), "part": pa.array([key[1]], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})
        for tasks, parts, counts in rows_in(batches, "task", "part", "counts", size=16):
            for t, k, c in zip(tasks, parts, counts, strict=True):
                add = np.frombuffer(zlib.decompress(c), "<u8")
                if (t, k) != key:
                    if key is not None:
                        yield done()
                    key, total = (t, k), add
                else:
                    total = total + add
        if key is not None:
            yield done()

    n = (sketches.agg(F.max("task")).first()[0] or 0) + 1
    rows = sketches.select("task", "part", "counts")
    while True:
        n = -(-n // FAN)
        rows = rows.withColumn("task", F.expr(f"task DIV {FAN}")).repartition(max(1, n * PARTS // 4), "task", "part").sortWithinPartitions("task", "part")
        rows = arrow(rows, run, "task long, part int, counts binary")
        if n == 1:
            break
        rows = materialize(rows)
    out = np.zeros((PARTS, SKETCH // PARTS), np.uint8)
    for r in rows.toLocalIterator():  # one row for each part
        out[r.part] = (2 * np.log2(np.frombuffer(zlib.decompress(bytes(r.counts)), "<u8").astype(np.float64) + 1)).astype(np.uint8)
    return out.ravel()


def _list_costs(small: DataFrame, level: np.ndarray) -> dict[int, tuple[int, float]]:
    """By size of the small sets: how many there are, and what it costs to stand in their lists (each: a posting and, of its block, bitmaps)."""
    shipped = small.sparkSession.sparkContext.broadcast(level)
    price = 1 + COMPARE * np.minimum(BLOCK, 2 ** (np.arange(256) / 2) - 1)

    def run(batches):
        out: dict[int, list[float]] = defaultdict(lambda: [0, 0.0])
        for (sets,) in rows_in(batches, "small", size=2000):
            for b in sets:
                s = np.frombuffer(b, np.uint64)
                got = out[len(s)]
                got[0] += 1
                got[1] += float(price[level_of(prefix(s, shipped.value), shipped.value)].sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array(out.keys(), pa.int64()), "k": pa.array([x[0] for x in out.values()], pa.int64()), "cost": pa.array([x[1] for x in out.values()], pa.float64())})

    rows = arrow(small.select("small"), run, "n long, k long, cost double").groupBy("n").agg(F.sum("k").alias("k"), F.sum("cost").alias("cost"))
    return {r.n: (r.k, r.cost) for r in rows.collect()}  # at most MOST rows


def level_of(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    return level[(s % np.uint64(SKETCH)).astype(np.int64)]


def bitmap(s: np.ndarray) -> bytes:
    """Parities of a set's counts in buckets: two bitmaps differ in no more bits than the sets differ in elements.

    The number of buckets, a power of two, is at least twice the set's size (within BITS); a bitmap folds to half its length by xor.
    """
    n = min(BITS[1], max(BITS[0], 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s % np.uint64(n)).astype(np.int64), minlength=n).astype(np.uint8) & 1).tobytes()


def _postings(docs: DataFrame, level: np.ndarray, light: int) -> DataFrame:
    """Per document with shingles doc_id, n, lists and subsets (arrays of keys) and bits."""
    shipped = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        shingle = Shingler()
        for ids, texts in rows_in(batches, "doc_id", "text", size=200):
            rows = [(i, len(s), *signatures(s, shipped.value, light), bitmap(s)) for i, s in zip(ids, shingle(texts), strict=True) if i is not None and len(s)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "lists": pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64())), "subsets": pa.array([r[3].view(np.int64) for r in rows], pa.list_(pa.int64())), "bits": pa.array([r[4] for r in rows], pa.binary())})

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, lists array<long>, subsets array<long>, bits binary")


def may_link(n: np.ndarray, bits: list[bytes], minor: np.ndarray | None = None) -> np.ndarray:
    """Of sets with these sizes and bitmaps, which may link with any other: no link is ever ruled out.

    minor: only pairs with one of these sets at least are looked at.

    Sets of sizes s and t that differ in d elements have (s + t - d) / 2 in common, and link if PERCENT (s + t + d) <= 100 (s + t - d).
    """
    out = np.zeros(len(n), bool)
    width = np.array([len(b) for b in bits])
    own = {w: np.flatnonzero(width == w) for w in set(width.tolist())}
    rows = {w: np.frombuffer(b"".join(bits[k] for k in ks), np.uint64).reshape(len(ks), -1) for w, ks in own.items()}

    def fold(m: np.ndarray, w: int) -> np.ndarray:
        while m.shape[-1] * 8 > w:
            m = m[..., : m.shape[-1] // 2] ^ m[..., m.shape[-1] // 2 :]
        return m

    for a in sorted(own):
        for b in sorted(w for w in own if w >= a):
            m, other = rows[a], fold(rows[b], a)
            for x, k in enumerate(own[a]):
                near = PERCENT * np.maximum(n[own[b]], n[k]) <= 100 * np.minimum(n[own[b]], n[k])
                if a == b:
                    near[x] = False
                if minor is not None and not minor[k]:
                    near &= minor[own[b]]
                near = np.flatnonzero(near)
                if len(near):
                    d = np.bitwise_count(other[near] ^ m[x]).sum(1, dtype=np.int64)
                    both = n[own[b][near]] + n[k]
                    hit = own[b][near[PERCENT * (both + d) <= 100 * (both - d)]]
                    if len(hit):
                        out[k] = out[hit] = True
    return out


def _likely(groups: DataFrame, partitions: int) -> DataFrame:
    """Of groups (hub, i, j, node, comp, minor, n, bits) the rows that by size and bitmap may link with another of their group."""
    rows = groups.repartition(partitions, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "node").select("hub", "i", "j", "node", "comp", "minor", "n", "bits")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["hub", "i", "j", "node", "comp", "minor"])

    def run(batches):
        out: list[tuple] = []
        for key, group in _runs(batches, 3):
            may = may_link(np.array([g[3] for g in group], np.int64), [g[4] for g in group], np.array([g[2] for g in group]))
            out += [(*key, *g[:3]) for g, ok in zip(group, may, strict=True) if ok]
            if len(out) > 5000:
                yield batch(out)
                out = []
        yield batch(out)

    return arrow(rows, run, "hub long, i int, j int, node long, comp long, minor boolean")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets left with the sets right."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out


def links(sets: list[np.ndarray], component: list[int], minor: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, without links inside a component that is already known.

    minor: only pairs with one of these sets at least are looked at.
    """
    size = np.array([len(s) for s in sets], np.int64)
    root = {c: c for c in component}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    every = np.arange(len(sets))
    left = every if minor is None else np.flatnonzero(minor)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        pairs = [(0, 1)] if 100 * both >= PERCENT * (size.sum() - both) else []
    else:
        both = _overlaps(sets, left, every).astype(np.int64)
        hit = 100 * both >= PERCENT * (size[left][:, None] + size[None, :] - both)
        a, b = np.nonzero(hit & (left[:, None] != every[None, :]))
        pairs = zip(left[a].tolist(), b.tolist(), strict=True)
    out = []
    for a, b in pairs:
        x, y = find(component[a]), find(component[b])
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _runs(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal first n_keys columns of sorted batches."""
    key, rows = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns), strict=True):
                if row[:n_keys] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[:n_keys], []
                rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _checked(groups: DataFrame, texts: DataFrame, partitions: int) -> DataFrame:
    """groups: hub, i, j, node, comp, minor; the links a, b found in each group (hub, i, j)."""
    rows = groups.join(texts, "node").select("hub", "i", "j", "node", "comp", "minor", "text")
    rows = rows.repartition(partitions, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "node")

    def run(batches):
        shingle = Shingler()
        kept: dict[int, np.ndarray] = {}  # sets of some nodes; a node stands in several groups
        for _, group in _runs(batches, 3):
            seen: dict[int, tuple] = {}
            for node, comp, minor, text in group:
                seen[node] = (comp, minor or (node in seen and seen[node][1]), text)
            nodes = list(seen)
            if len(nodes) < 2:
                continue
            if len(kept) > 4 * BLOCK:
                kept.clear()
            new = [k for k in nodes if k not in kept]
            kept.update(zip(new, shingle([seen[k][2] for k in new]), strict=True))
            found = links([kept[k] for k in nodes], [seen[k][0] for k in nodes], np.array([seen[k][1] for k in nodes]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(nodes[x], nodes[y]) for x, y in found], pa.int64()), "b": pa.array([max(nodes[x], nodes[y]) for x, y in found], pa.int64())})

    return arrow(rows, run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of each node of the edges (a, b), by large-star and small-star rounds."""
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node link to the node's least neighbour
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: neighbours below a node, and the node, link to the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        same = "count(*) AS n", "bit_xor(xxhash64(u, v)) AS h"
        done = now.selectExpr(*same).first() == after.selectExpr(*same).first()
        unmaterialize(now)
        now = after
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is one of ids (distinct), each doc_id once.

    Before the join, rows pass a bitmap over hashes of the ids, 16 bits an id within FILTER (4 KB by bucket): its size is bounded. What it lets
    through in error, the join drops; it only keeps texts from being shuffled for nothing.
    """
    n = ids.count()
    bits = min(FILTER[1], max(FILTER[0], 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marks = ids.select("doc_id", at.alias("at")).groupBy(F.expr("at DIV 32768").alias("_bucket")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("_marks"))
    rows = docs.withColumn("_at", at).withColumn("_bucket", F.expr("_at DIV 32768")).join(F.broadcast(marks), "_bucket")
    rows = rows.filter(F.expr("getbit(cast(conv(hex(substring(_marks, cast((_at % 32768) DIV 8 AS int) + 1, 1)), 16, 10) AS bigint), cast(_at % 8 AS int)) = 1"))
    return rows.select(*docs.columns).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _links(groups: DataFrame, docs: DataFrame, partitions: int) -> DataFrame:
    """Links a, b found in groups (hub, i, j, node, comp, minor, n, bits): by bitmaps, then by the texts of those that are left."""
    likely = materialize(_likely(groups, partitions))
    wanted = materialize(likely.select(F.col("node").alias("doc_id")).distinct())
    texts = materialize(_among(docs.select("doc_id", "text"), wanted).withColumnRenamed("doc_id", "node"))
    found = materialize(_checked(likely, texts, partitions))
    for done in (likely, wanted, texts):
        unmaterialize(done)
    return found


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    spark = docs.sparkSession
    partitions = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = materialize(_sets(docs))
    rows = first.filter(F.col("part").isNull()).select("doc_id", "n", "hi", "lo")
    classes = materialize(rows.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")).filter("rep IS NOT NULL"))
    reps = classes.select(F.col("rep").alias("doc_id"), "n")
    level = _levels(first.filter(F.col("part").isNotNull()))
    light = choose_boundary(_list_costs(first.filter("small IS NOT NULL").join(reps.filter(f"n <= {MOST}"), ["doc_id", "n"], "left_semi"), level))

    keys = materialize(_postings(docs, level, light).join(reps, ["doc_id", "n"], "left_semi"))
    postings = keys.select(F.col("doc_id").alias("node"), "n", F.explode("lists").alias("key"), F.lit(0).alias("kind")).unionByName(
        keys.select(F.col("doc_id").alias("node"), "n", F.explode("subsets").alias("key"), F.lit(1).alias("kind")))
    # most keys occur once: count them first (summed before the shuffle), so that only the others go on; a list needs a heavy member
    common = postings.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most")).filter(f"k > 1 AND (kind = 1 OR most > {light})").select("kind", "key")
    postings = materialize(postings.join(common, ["kind", "key"], "left_semi"))
    hubs = postings.groupBy("kind", "key").agg(F.min(F.struct("n", "node")).alias("hub")).select("kind", "key", F.col("hub.node").alias("hub"))
    stars = materialize(postings.join(hubs, ["kind", "key"]).filter("node != hub").select("hub", "node").distinct())
    unmaterialize(postings)

    blocks = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = stars.join(blocks, "hub").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    hub_rows = blocks.select("hub", "blocks", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    sketched = keys.select(F.col("doc_id").alias("node"), "n", "bits").dropDuplicates(["node"])
    members = members.select("hub", "blocks", "node", "i").unionByName(hub_rows)
    own = members.select("hub", "i", F.lit(0).alias("j"), "node", F.col("node").alias("comp"), F.lit(True).alias("minor")).join(sketched, "node")
    forest = _links(own, docs, partitions)
    comps = connected(forest)

    # Hubs of several blocks: whoever is outside the hub's largest component meets all other blocks.
    large = materialize(members.filter("blocks > 1").join(comps, "node", "left").select("hub", "blocks", "node", "i", F.coalesce("component", "node").alias("comp")))
    if large.head(1):
        major = large.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("hub").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
        marked = large.join(major, "hub").withColumn("minor", F.col("comp") != F.col("major"))
        outside = marked.filter("minor").groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_minor"))
        marked = materialize(marked.join(outside, "hub"))
        by_minor = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_minor")).cast("int")
        rows_minor = marked.filter("minor").select("hub", by_minor.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "comp", "minor")
        rows_all = marked.select("hub", F.explode(F.sequence(F.lit(0), F.col("n_minor") - 1)).alias("i"), F.col("i").alias("j"), "node", "comp", F.lit(False).alias("minor"))
        # a member may be on both sides of a group
        both = rows_minor.unionByName(rows_all).groupBy("hub", "i", "j", "node", "comp").agg(F.max("minor").alias("minor"))
        more = _links(both.join(sketched, "node"), docs, partitions)
        comps = connected(forest.unionByName(more))
        unmaterialize(marked)

    for done in (keys, stars, large, forest):
        unmaterialize(done)

    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: those with its least doc_id, each once. Rows without shingles or id stay."""
    rows = materialize(components(docs))
    firsts = rows.filter("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    alone = rows.filter("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", F.lit(1).cast("long").alias("k")).distinct()
    keep = firsts.unionByName(alone).groupBy("doc_id").agg(F.max("k").alias("k"))
    once = docs.join(keep.filter("k = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(keep.filter("k > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT k, doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d),
s AS MATERIALIZED (SELECT DISTINCT k, doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM p),
n AS MATERIALIZED (SELECT k, doc_id, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT a.k AS ka, c.k AS kb, count(*) AS inter FROM s a JOIN s c ON a.x = c.x AND a.k < c.k GROUP BY ALL),
l AS MATERIALIZED (SELECT a.doc_id AS u, c.doc_id AS v FROM b JOIN n a ON a.k = ka JOIN n c ON c.k = kb WHERE 100 * inter >= 80 * (a.n + c.n - inter)),
e AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(a, z) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.z),
c AS (SELECT a, min(z) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (k) LEFT JOIN c ON c.a = d.doc_id
"""
