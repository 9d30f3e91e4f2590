r"""Ranked lexical search: the best documents for every item of a query table, exactly.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
N counts the documents with a term, L their terms with repeats, n a document's terms, df the documents that
hold a term, tf its occurrences in one.  A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); with
m = 10 + 90 n N div L, a document scores the sum of w * (10^9 tf div (1000 tf + 8 m)) over an item's terms, each once.

1. Items are taken in blocks of ``QUERY_BLOCK``.  For each, one scan of the documents keeps, of every document
   with a term, its length and the counts of the block's terms (written to the shared folder).  N, L and df are
   aggregates of that; what reaches the driver is a number for each of the block's terms.
2. A task sorts a buffer of documents by length and takes them in chunks (bounds are tight where lengths are
   alike).  In a chunk every term is a bitmap of its documents, and w times its largest factor bounds what it adds.
3. Presence masks.  A chunk's documents are split term after term, by AND with the bitmap and the rest, into groups
   of equal masks.  A group in the making is bounded by the terms it holds and those still open; the
   group of the largest bound is split next.  So finished masks come out by descending
   bound, and their documents are scored exactly.  The item is done in the chunk when the bound falls below the item's
   k-th best score so far, which is carried from chunk to chunk.
4. A task leaves at most k rows an item; ranks are made from those.

Null and blank texts have no terms: such documents are not counted or found, such items have no rows.  Equal scores go by
ascending doc_id (none last).  Rows of equal doc_id are documents of their own; so are items, each ranked for itself.  No
documents or no items: no rows.  Other columns take no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.llm.common import cut

#: Items searched in one scan; documents sorted by length together, and in a chunk.
QUERY_BLOCK, BUFFER, CHUNK = 1024, 1 << 16, 1 << 13
#: Counts of terms held in a buffer (a buffer ends at this many, whatever its documents).
BUFFER_COUNTS = 4 << 20
BEST = 10
#: The characters of terms as a pattern (for SQL), and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, TF, LENGTH, FLOOR, SLOPE = 1_000_000_000, 1000, 8, 10, 90

#: Bytes of terms as they are, capitals lowered, all else a space.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Chunk:
    """Documents of like length: for each of their terms a bitmap, the factors, and the largest of them."""

    def __init__(self, ids: list, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, total: int, all_terms: int):
        self.ids, self.bytes = ids, -(-len(ids) // 8)
        m = FLOOR + SLOPE * lengths * total // max(all_terms, 1)
        factor = SCALE * tf // (TF * tf + LENGTH * m[doc])
        order = np.lexsort((doc, term))
        doc, term, factor = doc[order], term[order], factor[order]
        names, starts = np.unique(term, return_index=True)
        self.most = dict(zip(names.tolist(), np.maximum.reduceat(factor, starts).tolist(), strict=True)) if len(names) else {}
        ends = [*starts[1:].tolist(), len(term)][:len(names)]
        self.rows = {t: (doc[a:b], factor[a:b]) for t, a, b in zip(names.tolist(), starts.tolist(), ends, strict=True)}
        self.bitmaps: dict[int, int] = {}

    def bitmap(self, term: int) -> int:
        if term not in self.bitmaps:
            held = np.zeros(self.bytes * 8, bool)
            held[self.rows[term][0]] = True
            self.bitmaps[term] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        return self.bitmaps[term]

    def places(self, bitmap: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap.to_bytes(self.bytes, "little"), np.uint8), bitorder="little"))

    def scores(self, places: np.ndarray, mask: list[tuple[int, int]]) -> np.ndarray:
        """Scores of documents that all hold the mask's (term, weight) and none else of the item's."""
        out = np.zeros(len(places), np.int64)
        for t, w in mask:
            doc, factor = self.rows[t]
            out += w * factor[np.searchsorted(doc, places)]
        return out


def search(chunk: Chunk, wanted: list[tuple[int, int]], best: list, k: int) -> int:
    """Carry ``best`` (a heap of (score, order, doc_id), at most k) over the chunk; returns the masks scored."""
    own = sorted(((w * chunk.most[t], t, w) for t, w in wanted if w > 0 and t in chunk.most), reverse=True)
    own = [x for x in own if x[0] > 0]
    bound = sum(x[0] for x in own)
    if not own or len(best) == k and bound < best[0][0]:
        return 0
    maps, everything, scored = [chunk.bitmap(t) for _, t, _ in own], 0, 0
    for b in maps:
        everything |= b
    # (-bound, number, depth, documents, mask as a chain): documents agree in the terms up to depth
    open_groups, number = [(-bound, 0, 0, everything, None)], 0
    while open_groups:
        bound, _, depth, group, chain = heapq.heappop(open_groups)
        bound = -bound
        if len(best) == k and bound < best[0][0]:
            break
        while depth < len(own):
            has = group & maps[depth]
            rest = group ^ has
            if rest:
                number += 1
                less = bound - own[depth][0]
                if len(best) < k or less >= best[0][0]:
                    heapq.heappush(open_groups, (-less, number, depth + 1, rest, chain))
            if not has:
                group = 0
                break
            group, chain = has, (own[depth][1:], chain)
            depth += 1
        if not group:
            continue
        mask = []
        while chain is not None:
            mask.append(chain[0])
            chain = chain[1]
        if not mask:
            continue
        scored += 1
        places = chunk.places(group)
        found = chunk.scores(places, mask)
        least = best[0][0] if len(best) == k else 1
        for at in np.flatnonzero(found >= max(least, 1)).tolist():
            key = chunk.ids[places[at]]
            entry = (int(found[at]), key is not None, -(key or 0))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return scored


# --- Spark ---------------------------------------------------------------------

def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of the documents with a term: all terms' number, and the vocabulary's terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            ids, n, held, counts = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(text)
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    ids.append(key)
                    n.append(len(words))
                    held.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def _chunks(buffer: list[pa.RecordBatch], total: int, all_terms: int) -> Iterator[Chunk]:
    table = pa.Table.from_batches(buffer).combine_chunks()
    lengths = table.column("n").to_numpy()
    order = np.argsort(lengths, kind="stable")
    for start in range(0, len(order), CHUNK):
        part = table.take(pa.array(order[start:start + CHUNK]))
        term, tf = (part.column(c).combine_chunks() for c in ("term", "tf"))
        sizes = np.diff(term.offsets.to_numpy())
        yield Chunk(part.column("doc_id").to_pylist(), part.column("n").to_numpy(), np.repeat(np.arange(len(sizes)), sizes),
                    term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), total, all_terms)


def _found(counted: DataFrame, wanted: list[list[tuple[int, int]]], total: int, all_terms: int, k: int) -> DataFrame:
    """(at, doc_id, score): of each partition's documents the k best for each item (by its place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in wanted]

        def work(buffer):
            for chunk in _chunks(buffer, total, all_terms):
                for own, found in zip(wanted, best, strict=True):
                    search(chunk, own, found, k)

        buffer, rows, counts = [], 0, 0
        for batch in batches:
            buffer.append(batch)
            rows, counts = rows + batch.num_rows, counts + len(batch.column("term").flatten())
            if rows >= BUFFER or counts >= BUFFER_COUNTS:
                work(buffer)
                buffer, rows, counts = [], 0, 0
        if rows:
            work(buffer)
        out = [(at, -key if known else None, score) for at, found in enumerate(best) for score, known, key in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in
                                          ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))], names=["at", "doc_id", "score"])

    return counted.mapInArrow(run, "at int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = cut(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "items")
    kind = items.schema["item_id"].dataType.simpleString()
    blocks = max(1, -(-items.count() // QUERY_BLOCK))
    dealt = items.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = dealt.where(F.col("__block") == block).select("item_id", "text").collect()     # about QUERY_BLOCK items
        per_item = [sorted(set(terms(r["text"].encode() if r["text"] else None))) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*per_item)))} if per_item else {}
        if not vocabulary:
            continue
        counted = cut(_counted(docs, vocabulary), "term-counts")
        total, all_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(counted.select(F.explode("term").alias("term")).groupBy("term").count().collect())  # a row for each of the block's terms
        wanted = [[(i, weight(total, df[i])) for i in map(vocabulary.__getitem__, own) if i in df] for own in per_item]
        found = _found(counted, wanted, total, all_terms, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"at int, item_id {kind}")
        order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(top.join(F.broadcast(names), "at").select("item_id", "rank", "doc_id", "score"))
    return out


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL for ``rank`` of ``documents`` for ``benchmark``.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
lens AS (SELECT doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lens),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{TERM}')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, totals GROUP BY term, docs),
s AS (SELECT item_id, doc_id,
             sum(w * (({SCALE} * tf) // ({TF} * tf + {LENGTH} * ({FLOOR} + ({SLOPE} * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN lens USING (doc_id), totals GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {BEST}
"""
