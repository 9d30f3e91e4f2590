r"""N-gram Jaccard self-join with count vectors, an R-tree, and exact verification.

A document's set holds its distinct word n-grams of ``size`` words (one 64-bit hash each).  Two sets link
when |A and B| >= ``similarity`` * |A or B|; that is read as a decimal fraction s and compared in whole numbers.

1. Equal sets are one class, represented by its smallest doc_id; all else is about classes.
2. Dealing.  Linked sets differ in at most (|A| + |B|) * (1 - s) / (1 + s) elements (a 19th at 0.9).  Elements
   are hashed into more groups than that, so at least one group has the same content in both.  A set with
   elements in more groups than can differ leaves out its empty ones, as one of the others is then shared.  Sizes
   fall into geometric bands (a set takes part in its own band, and in the one below if a linked set may lie there),
   and a key is band, group and a hash of the group's content.  Linked classes share a bucket.  Of buckets
   with the same members one stays.
3. R-tree.  The members' group counts are points of an R-tree in each bucket.  Sets differ in at least the summed
   differences of their counts (the overlap is at most the sum of the smaller counts), and from a node's box
   likewise.  Two searches, each over the buckets that hold several components:
   a. every member names its nearest point in reach; of those each set keeps the nearest over all its
      buckets, so there is at most one pair a set to verify.  Buckets of more than ``BLOCK`` members are dealt into
      blocks, and searched a second time between components, with blocks dealt anew;
   b. all pairs of blocks: the graph of points of different components in reach leaves a task as a spanning
      forest, less than an edge a member.  Its connected parts over all buckets are families, and every pair that still can
      link lies in one.  So each set goes to its family once, whole, where an R-tree of the family finds
      the pairs, sets that are verified become one, and only links that merge something leave the task.
4. Verification of a ships a large set as three bytes of each hash.  Those count no overlap too low, so
   they refute exactly and confirm with a margin; pairs inside the margin are verified on whole hashes.
5. Components of all verified links.

Nothing is capped: every linked pair shares a bucket, and a bucket is left only when its
members are one component.  Null, blank and empty texts have empty sets and are linked
with nothing.  Rows without an id get no component of their own: theirs is that of an equal
set, or null.  Of different texts with one id the smallest set stands for the id in links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.common import cut, shuffle_partitions
from rejoinder.llm.components import components

WORDS_IN_SHINGLE, SIMILARITY = 3, 0.9
#: Bands are this much wider than linked sizes differ (in logarithms), so that rounding cannot put those two bands apart.
WIDER, SLACK = 1.5, 0.011
#: Coordinates of a point, members of a bucket compared in one task, fan-out of the tree.
GROUPS, BLOCK, FAN = 256, 1024, 16
#: Sets of more elements are shipped as three bytes of each hash; false agreements that a verified pair may have beyond four times those expected.
WHOLE, MARGIN = 512, 6
#: A list of ids is broadcast up to this many rows; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and low bits of hashes are well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; with fewer words, of the whole sequence."""
    words = (text or "").encode().lower().split()       # bytes: lowers A-Z, splits at space and 09-0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    total = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(len(words), size)):
        total = _mix(total + h[k:k + n])
    return np.unique(total)


@lru_cache
def ratio(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction of whole numbers."""
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity {similarity} is not in (0, 1]")
    return Fraction(str(similarity)).as_integer_ratio()


def _width(similarity: float) -> float:
    return WIDER * math.log(1 / similarity) + SLACK


def band(n: int, similarity: float = SIMILARITY) -> int:
    return int(math.log(n) / _width(similarity))


@lru_cache(4096)
def groups_of(b: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(elements in which a set of band ``b`` and a linked one, no smaller, can differ; groups: one more, and for empty ones)."""
    num, den = ratio(similarity)
    least, most = math.exp(b * _width(similarity)), math.ceil(math.exp((b + 1) * _width(similarity)))
    differ = (most + most * den // num) * (den - num) // (den + num)
    n = differ + 1
    return differ, n + min(n, int(2 * n * math.exp(-least / n)))


def keys(s: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The bucket keys of a set.  Sets too small to differ in one element (fewer than nine at 0.9) link only with equal ones."""
    num, den = ratio(similarity)
    if not len(s) or len(s) * (den - num) < num:
        return np.zeros(0, np.uint64)
    out, own = [], band(len(s), similarity)
    least = -(-len(s) * num // den)                     # the smallest linked set
    for b in range(max(min(own, band(max(least - 1, 1), similarity)), 0), own + 1):
        differ, n = groups_of(b, similarity)
        group = ((s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(n, np.uint64)
        np.add.at(content, group, _mix(s + np.uint64(b)))
        key = _mix(content + _mix(np.arange(n, dtype=np.uint64) + np.uint64(b << 32)))
        filled = np.bincount(group, minlength=n) > 0
        out.append(key[filled] if np.count_nonzero(filled) > differ else key)
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    num, den = ratio(similarity)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and den * both >= num * (len(a) + len(b) - both)


def point(s: np.ndarray) -> np.ndarray:
    """Elements by group, held at 255 (distances only shrink by that, so bounds stay bounds)."""
    return np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


class CountTree:
    """A bulk-loaded R-tree of count vectors; points with equal neighbours by size and counts share a leaf."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points.T[:4], sizes))
        self.points, self.sizes = points[self.order].astype(np.int16), sizes[self.order]
        low, high, least = self.points, self.points, self.sizes
        self.levels = []
        while len(least) > 1 or not self.levels:
            cuts = np.arange(0, len(least), FAN)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            least = np.minimum.reduceat(least, cuts)
            self.levels.append((low, high, least))

    def near(self, q: np.ndarray, size: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the points whose overlap with ``q`` may reach the similarity."""
        num, den = ratio(similarity)
        nodes = np.arange(len(self.levels[-1][0]))
        q = q.astype(np.int16)
        for level in range(len(self.levels) - 1, -1, -1):
            low, high, least = (x[nodes] for x in self.levels[level])
            apart = (np.maximum(low - q, 0) + np.maximum(q - high, 0)).sum(1, dtype=np.int64)
            # a linked set has at most size / s elements, and differs in at most (1 - s) / (1 + s) of both: (1 - s) / s of size
            keep = nodes[(num * apart <= (den - num) * size) & (num * least <= den * size)]
            nodes = (keep[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < (len(self.points) if level == 0 else len(self.levels[level - 1][0]))]
        apart = np.abs(self.points[nodes] - q).sum(1, dtype=np.int64)
        fine = (den + num) * apart <= (den - num) * (size + self.sizes[nodes])
        return self.order[nodes[fine]], apart[fine]


def nearest(points: np.ndarray, sizes: np.ndarray, component: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """For each point the place of the nearest point in reach that is of another component (-1: none), and the distance by size."""
    num, den = ratio(similarity)
    n = len(sizes)
    at, gap = np.full(n, -1), np.zeros(n)
    if n <= FAN:                                        # one leaf: all its points at once
        wide = points.astype(np.int16)
        apart = np.abs(wide[:, None] - wide[None]).sum(2, dtype=np.int64)
        both = sizes[:, None] + sizes[None]
        far = ((den + num) * apart > (den - num) * both) | (component[:, None] == component[None])
        part = np.where(far, np.inf, apart / both)
        best = part.argmin(1)
        gap = part[np.arange(n), best]
        return np.where(np.isinf(gap), -1, best), gap
    tree = CountTree(points, sizes)
    for k in range(n):
        found, apart = tree.near(points[k], int(sizes[k]), similarity)
        other = component[found] != component[k]
        if other.any():
            part = apart[other] / (sizes[found[other]] + sizes[k])
            best = part.argmin()
            at[k], gap[k] = found[other][best], part[best]
    return at, gap


def forest(points: np.ndarray, sizes: np.ndarray, component: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest (pairs of places) of the graph of points of different components in reach of each other."""
    num, den = ratio(similarity)
    n, out, label = len(sizes), [], np.arange(len(sizes))
    tree = CountTree(points, sizes) if n > FAN else None
    if tree is None:                                    # one leaf: all its points at once
        wide = points.astype(np.int16)
        apart = np.abs(wide[:, None] - wide[None]).sum(2, dtype=np.int64)
        reach = ((den + num) * apart <= (den - num) * (sizes[:, None] + sizes[None])) & (component[:, None] != component[None])
    for k in range(n):
        found = np.flatnonzero(reach[k]) if tree is None else tree.near(points[k], int(sizes[k]), similarity)[0]
        found = found[(label[found] != label[k]) & (component[found] != component[k])]
        if len(found):
            labels, first = np.unique(label[found], return_index=True)
            out += [(k, int(f)) for f in found[first]]
            label[np.isin(label, labels)] = label[k]
    return out


def merging(sets_: list[np.ndarray], points: np.ndarray, sizes: np.ndarray, component: np.ndarray,
            similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of places whose sets link and that join components, found by the tree, nearest first: one for each merge."""
    tree, label, out = CountTree(points, sizes), component.copy(), []
    for k in range(len(sizes)):
        found, apart = tree.near(points[k], int(sizes[k]), similarity)
        for f in found[np.argsort(apart, kind="stable")].tolist():
            if f > k and label[f] != label[k] and linked(sets_[k], sets_[f], similarity):
                out.append((k, f))
                label[label == label[f]] = label[k]
    return out


def packed(s: np.ndarray) -> bytes:
    """A sorted set as bytes: whole hashes, of a large set their first three bytes."""
    if len(s) <= WHOLE:
        return s.tobytes()
    return (s >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(n: int, data: bytes) -> np.ndarray:
    if n <= WHOLE:
        return np.frombuffer(data, np.uint64)
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(n, 3)
    return wide.view("<u4").ravel().astype(np.uint64)


def verdict(n: int, a: bytes, m: int, b: bytes, similarity: float = SIMILARITY) -> int:
    """Whether two packed sets link: 1 yes, 0 no, -1 not to be told from three bytes."""
    num, den = ratio(similarity)
    least = -(-num * (n + m) // (den + num))
    x, y = _unpacked(n, a), _unpacked(m, b)
    if n <= WHOLE and m <= WHOLE:
        return int(len(np.intersect1d(x, y, assume_unique=True)) >= least)
    # agreements of truncated hashes, with repeats: no fewer than there are of whole ones
    x, y = ((v >> np.uint64(40) if k <= WHOLE else v) for v, k in ((x, n), (y, m)))
    x, y = ((v.astype(np.int64) << 24) + np.arange(len(v)) - np.searchsorted(v, v) for v in (x, y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both < least:
        return 0
    return 1 if both >= least + MARGIN + 4 * n * m // (1 << 24) else -1


# --- Spark ---------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches, a few rows at a time: what is made of long texts is held for those only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """(doc_id, n, h1, h2): size and 128-bit hash of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h = [], []
            for piece in _pieces([batch]):
                for text in piece.column(1).to_pylist():
                    s = shingles(text, size)
                    n.append(len(s))
                    h.append(xxhash.xxh3_128_digest(s.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()),
                 *(pa.array([int.from_bytes(x[k:k + 8], "little", signed=True) for x in h], pa.int64()) for k in (0, 8))],
                names=["doc_id", "n", "h1", "h2"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
               .mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def _picked(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """(doc_id, text) of the documents in ``ids`` (id)."""
    ids = F.broadcast(ids) if count <= BROADCAST_ROWS else ids
    return docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")


def _keyed(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, id) of the documents' sets."""

    def run(batches):
        for batch in _pieces(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            many, out, size = [], [], 0
            for at, t in enumerate(texts):
                out.append(keys(shingles(t, words), similarity).view(np.int64))
                many.append(len(out[-1]))
                size += many[-1]
                if size > 200_000 or at + 1 == len(texts):
                    held = np.repeat(np.array(ids[at + 1 - len(many):at + 1], np.int64), many)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(held)], names=["key", "id"])
                    many, out, size = [], [], 0

    return docs.select("doc_id", "text").mapInArrow(run, "key long, id long")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keys that several ids have; streams over rows sorted by key, holding one back."""

    def run(batches):
        rest, before = None, None                       # the row held back, and the key ahead of it
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if rest is None else pa.concat_batches([rest, batch])
            yield part(table, before, False)
            key = table.column("key")
            before = key[len(key) - 2].as_py() if len(key) > 1 else before
            rest = table.slice(len(key) - 1)
        if rest is not None:
            yield part(rest, before, True)

    def part(table, before, last):
        """Rows whose key stands before or after them too; the last row waits for its successor."""
        key = table.column("key").to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        keep = np.concatenate([[key[0] == before], same]) | np.concatenate([same, [False]])
        keep[len(key) - (not last):] = False
        return table.filter(pa.array(keep))

    return keyed.repartition(shuffle_partitions(keyed), "key").sortWithinPartitions("key").mapInArrow(run, "key long, id long")


def buckets(shared: DataFrame) -> DataFrame:
    """(key, id, m) of one bucket of each set of members, with their number; members are told by two sums of hashes."""
    rows = shared.distinct()
    summed = rows.groupBy("key").agg(F.count("*").alias("m"), *(
        F.sum(F.xxhash64("id", F.lit(salt)).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)))
    chosen = summed.where("m > 1").groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key", "m")
    return rows.join(chosen, "key")


def _sets_of(docs: DataFrame, size: int, whole: bool) -> DataFrame:
    """(id, n, s, p): the sets (whole, or packed) with their size and their points, as bytes."""

    def run(batches):
        for batch in _pieces(batches):
            rows = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in rows], pa.int64()),
                pa.array([s.tobytes() if whole else packed(s) for s in rows], pa.binary()),
                pa.array([point(s).tobytes() for s in rows], pa.binary())], names=["id", "n", "s", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n long, s binary, p binary")


def _sets_of_ids(docs: DataFrame, ids: DataFrame, size: int, whole: bool) -> DataFrame:
    """(id, n, s, p) of the ids, one set each: of several texts with one id the smallest set."""
    picked = _picked(docs, ids, ids.count())
    repeated = cut(picked.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")), "repeated-ids")
    count = repeated.count()
    held = _sets_of(picked, size, whole)
    if not count:
        return held
    repeated = F.broadcast(repeated) if count <= BROADCAST_ROWS else repeated
    least = held.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("n", "s", "p")).alias("x")).select("id", "x.n", "x.s", "x.p")
    return held.join(repeated, "id", "left_anti").unionByName(least)


def verified(pairs: DataFrame, held: DataFrame, docs: DataFrame, size: int, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that link, by packed sets in ``held`` (id, n, s), and by whole ones of ``docs`` where those cannot tell."""
    num, den = ratio(similarity)
    pairs = cut(pairs, "pairs")

    @F.arrow_udf("int")
    def check(n: pa.Array, x: pa.Array, m: pa.Array, y: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (n, x, m, y)), strict=True)
        return pa.array([verdict(*r, similarity) for r in rows], pa.int32())

    def both(pairs, held):
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        count = ids.count()
        held = held.join(F.broadcast(ids) if count <= BROADCAST_ROWS else ids, "id", "left_semi")
        a = held.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        b = held.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        return pairs.join(a, "a").join(b, "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))

    told = cut(both(pairs, held).select("a", "b", check("na", "sa", "nb", "sb").alias("v")).where("v != 0"), "told")
    open_ = told.where("v < 0").select("a", "b")
    if not open_.limit(1).count():
        return told.select("a", "b")

    @F.arrow_udf("boolean")
    def check_whole(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity)
                         for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    ids = open_.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # sets are written before they are joined: making and checking them in one stage takes two Python workers a task
    whole = both(open_, cut(_sets_of_ids(docs, ids, size, True), "whole-sets")).where(check_whole("sa", "sb")).select("a", "b")
    return told.where("v > 0").select("a", "b").unionByName(cut(whole, "told"))


def _runs(batches, names: list[str]):
    """Tables of the rows that agree in ``names``, from rows sorted by them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        columns = [table.column(c).to_numpy() for c in names]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(start, end - start)
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest


def _labelled(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` (key, id, m) of buckets that hold several components, with each row's component."""
    if comp is None:
        return rows.withColumn("component", F.col("id"))
    labelled = rows.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = labelled.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key")
    return cut(labelled.join(several, "key").select("key", "id", "m", "component"), "open")


def _points(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("p").to_pylist()), np.uint8).reshape(-1, GROUPS)


def proposals(rows: DataFrame, held: DataFrame, similarity: float, salt: int) -> DataFrame:
    """(a, b): for each id of ``rows`` (key, id, m, component) the nearest id in reach of another component; at most one an id."""

    def run(batches):
        for table in _runs(batches, ["key", "part"]):
            if table.num_rows < 2:
                continue
            ids, n, comp = (table.column(c).to_numpy() for c in ("id", "n", "component"))
            at, gap = nearest(_points(table), n, comp, similarity)
            has = at >= 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[at[has]]), pa.array(gap[has])], names=["a", "b", "gap"])

    part = F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col("m") / BLOCK)).cast("int")
    dealt = rows.withColumn("part", part).join(held.select("id", "n", "p"), "id").select("key", "part", "id", "n", "component", "p")
    named = dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long, gap double")
    best = named.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to every pair (i, j) of their bucket's blocks; a task of one pair holds two blocks."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    return (rows.withColumn("__blocks", blocks).withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
                .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
                .withColumns({"i": F.least("__own", "__other"), "j": F.greatest("__own", "__other")})
                .drop("__blocks", "__own", "__other"))


def families(rows: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(key, id): the family of every id of ``rows`` (key, id, m, component) that has a point of another component in reach."""

    def run(batches):
        for table in _runs(batches, ["key", "i", "j"]):
            if table.num_rows < 2:
                continue
            ids, n, comp = (table.column(c).to_numpy() for c in ("id", "n", "component"))
            found = forest(_points(table), n, comp, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[x[k]]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = _block_pairs(rows).join(held.select("id", "n", "p"), "id").select("key", "i", "j", "id", "component", "n", "p")
    named = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")
    edges = cut(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "reach")
    parts = components(edges)
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.join(parts, "id", "left").select(F.coalesce("component", "id").alias("key"), "id")


def merging_links(rows: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that merge components of ``rows`` (key, i, j, id, component), verified on whole sets inside the tasks."""

    def run(batches):
        for table in _runs(batches, ["key", "i", "j"]):
            if table.num_rows < 2:
                continue
            ids, n, comp = (table.column(c).to_numpy() for c in ("id", "n", "component"))
            held = [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
            found = merging(held, _points(table), n, comp, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[x[k]]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.join(whole, "id").select("key", "i", "j", "id", "component", "n", "s", "p")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _linked_components(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, component) of the documents (doc_id, text; one for each class) that link with a smaller id."""
    rows = cut(buckets(cut(_shared(_keyed(docs, size, similarity)), "shared")), "buckets")
    nodes = rows.select("id").distinct()
    held = cut(_sets_of_ids(docs, nodes, size, False), "node-sets")
    comp, links = None, None
    for salt in (0, 1):
        some = rows if comp is None else rows.where(F.col("m") > BLOCK)
        if comp is not None and not some.limit(1).count():
            break
        found = verified(proposals(_labelled(some, comp), held, similarity, salt), held, docs, size, similarity)
        links = found if links is None else links.unionByName(found)
        comp = components(links)
    near = cut(families(_labelled(rows, comp), held, similarity), "families")
    if not near.limit(1).count():
        return comp
    near = near.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    dealt = _block_pairs(near.join(near.groupBy("key").agg(F.count("*").alias("m")), "key"))
    whole = cut(_sets_of_ids(docs, near.select("id"), size, True), "whole-sets")
    return components(links.unionByName(merging_links(dealt, whole, similarity)))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS_IN_SHINGLE,
         similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles (of ``size`` words), component_id (of links from ``similarity`` up)."""
    ratio(similarity)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = cut(sets(docs, size=size), "sets")
    classes = own.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    classes = cut(classes, "classes")
    # the other members of a class take no part from here on; they are told by their ids
    rest = own.where("n > 0").join(classes.where("m > 1"), ["n", "h1", "h2"]).where("doc_id != rep").select(F.col("doc_id").alias("id"))
    rest = cut(rest.distinct(), "copies")
    n_rest = rest.count()
    left = docs.where(F.col("doc_id").isNotNull())
    other = F.broadcast(rest) if n_rest <= BROADCAST_ROWS else rest
    reps = left.join(other, left["doc_id"] == other["id"], "left_anti")
    comp = _linked_components(reps, size, similarity)
    by_class = (classes.join(comp, classes["rep"] == comp["id"], "left")
                       .select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id")))
    return (own.join(by_class, ["n", "h1", "h2"], "left")
               .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, *, size: int = WORDS_IN_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that are the first of their component, with their own columns; rows without an id stay."""
    found = join(docs, size=size, similarity=similarity).groupBy("doc_id").agg(F.min("component_id").alias("__component"))
    drop = found.where("doc_id != __component").select(F.col("doc_id").alias("__id"))
    return docs.join(drop, docs["doc_id"] == drop["__id"], "left_anti")
