"""Benchmark decontamination over a distributed positional inverted index.

The index is split by document: a shard holds, for some hundreds of whole
texts, the postings (places of the words) of every term in them. It knows
nothing of the test items, so one index serves any number of searches. Shards
are written to the shared folder, so a lost executor costs a re-read.

A search takes each window of each item, starts from the postings of its
rarest term in the shard, and intersects them with the postings of the terms
beside it, nearest first, each list shifted by its term's offset. A window one
of whose terms the shard lacks, or none of whose places survive, is dropped at
once. ``exact`` finds phrases word for word. ``near`` finds windows most of
whose words lie close to their places; as words may be missing, it starts from
several of a window's rarest terms. No posting is ever shuffled.

Terms are 64-bit hashes of words. Test items are taken in blocks of bounded
size; a block is sent to all executors, and the blocks' results are merged by
document.

Who only wants to be rid of the documents with matches calls ``without``: each
shard is then searched as soon as it is made, in the pass that reads the rows,
and the rows themselves are passed on. Nothing is written, shuffled or joined.

Null texts have no words. Items without words are ignored; words hit by an
item whose id is null count, but such an item is not listed. Rows that repeat
are judged row by row. Other columns are never read. Without documents there
are no rows, without items no hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common, vector

WINDOW = 13
#: Bytes of item texts in one block.
BLOCK_BYTES = 16 << 20
#: Texts in one shard, at most.
SHARD_ROWS = 512
#: Bytes of a text's digest, the beginning of its SHA-256.
DIGEST = 16

#: Bytes between words: ASCII other than digits and letters.
_APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all texts in order, A-Z lower-cased, and where each text's begin (len + 1)."""
    data, offsets = vector.buffers(texts)
    starts, ends, first = vector.words(data, offsets, _APART)
    return vector.word_hashes(data, starts, ends), first


@dataclass(frozen=True)
class Queries:
    """Items as places in one array of term numbers, with gaps between them."""

    ids: tuple
    vocabulary: np.ndarray  # term numbers count these, sorted
    flat: np.ndarray
    item_of: np.ndarray
    windows: dict  # length: places of the windows of that length
    need: np.ndarray  # by place: the length of its item's windows


_GAP = WINDOW
#: Windows that a search takes at a time; of a proximity search also postings of their anchors.
_TRIED = 1 << 16


@lru_cache(maxsize=2)
def queries(items: tuple[tuple[int | None, bytes], ...]) -> Queries:
    """``items``: (item_id, text)."""
    terms, first = _terms(pa.array([t for _, t in items], pa.large_binary()))
    vocabulary, number = np.unique(terms, return_inverse=True)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    begin = _GAP + np.cumsum(sizes[full] + _GAP) - (sizes[full] + _GAP)  # of each item that has words
    total = _GAP + int((sizes[full] + _GAP).sum())
    flat, item_of, need = np.full(total, -2, np.int64), np.full(total, -1, np.int64), np.zeros(total, np.int64)
    windows: dict[int, list[np.ndarray]] = {}
    for k, (i, at) in enumerate(zip(full.tolist(), begin.tolist(), strict=True)):
        n = int(sizes[i])
        size = min(WINDOW, n)
        flat[at : at + n] = number[first[i] : first[i + 1]]
        item_of[at : at + n], need[at : at + n] = k, size
        windows.setdefault(size, []).append(np.arange(at, at + n - size + 1))
    return Queries(tuple(items[i][0] for i in full.tolist()), vocabulary, flat, item_of, {k: np.concatenate(v) for k, v in windows.items()}, need)


def _postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, terms, firsts and postings of a shard of these texts, as ``build_index`` has them; starts has one more, an end."""
    h, first = _terms(texts)
    n = np.arange(len(texts) + 1)
    places = np.arange(len(h)) + np.repeat(n[:-1], np.diff(first))
    order = np.argsort(h, kind="stable")
    terms, firsts = np.unique(h[order], return_index=True)
    return first + n, terms.view(np.int64), np.append(firsts, len(h)), places[order]


INDEX = "doc_ids array<long>, digests array<binary>, starts array<int>, terms array<long>, firsts array<int>, postings array<int>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard.

    doc_ids and digests are of its documents; starts[k] is the place of document
    k's first word, and one place stays free after each document. The postings
    of terms[k], places in order, are postings[firsts[k]:firsts[k + 1]].
    """
    kind = [("doc_ids", pa.int64()), ("digests", pa.binary()), ("starts", pa.int32()), ("terms", pa.int64()), ("firsts", pa.int32()), ("postings", pa.int32())]

    def run(batches):
        for batch in batches:
            digests = [sha256(t or b"").digest()[:DIGEST] for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            arrays = _postings(batch.column(1))
            values = [batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), *(pa.array(x, t) for x, (_, t) in zip(arrays, kind[2:], strict=True))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
            yield pa.RecordBatch.from_arrays(lists, names=[k for k, _ in kind])

    return common.in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, INDEX, rows=SHARD_ROWS)


_PLACE = 1 << 32


class Shard:
    """A shard's postings of the terms that the items have, as sorted pairs of term number and place."""

    def __init__(self, q: Queries, starts, terms, firsts, postings) -> None:
        self.starts, terms = starts.astype(np.int64), terms.view(np.uint64)
        n = len(q.vocabulary)
        at = np.searchsorted(terms, q.vocabulary)
        there = np.flatnonzero(at < len(terms))
        there = there[terms[at[there]] == q.vocabulary[there]]
        self.count = np.zeros(n + 2, np.int64)  # the last two, found as -2 and -1, are for gaps
        self.count[there] = np.diff(firsts)[at[there]]
        self.first = np.zeros(n + 2, np.int64)
        self.first[:n] = np.cumsum(self.count[:n]) - self.count[:n]
        size = self.count[there]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.places = postings.astype(np.int64)[np.repeat(firsts[at[there]].astype(np.int64), size) + within]
        self.pairs = np.repeat(there, size) * _PLACE + self.places

    def posted(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term has a posting at the place beside it: the intersection of shifted lists, by binary search."""
        if not len(self.pairs):
            return np.zeros(len(terms), bool)
        sought = terms * _PLACE + places
        at = np.minimum(np.searchsorted(self.pairs, sought), len(self.pairs) - 1)
        return (self.pairs[at] == sought) & (terms >= 0) & (places >= 0)

    def rarest(self, q: Queries) -> np.ndarray:
        """The place of the rarest term of each window all of whose terms are in the shard."""
        counts = self.count[q.flat]
        rare = [np.zeros(0, np.int64)]
        for size, every in q.windows.items():
            for i in range(0, len(every), _TRIED):
                at = every[i : i + _TRIED]
                seen = np.lib.stride_tricks.sliding_window_view(counts, size)[at]
                pick = seen.argmin(axis=1)
                there = seen[np.arange(len(at)), pick] > 0
                rare.append(at[there] + pick[there])
        return np.concatenate(rare)

    def candidates(self, q: Queries, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each anchor's number, once for each posting of its term, and that posting."""
        terms = q.flat[anchors]
        n = self.count[terms]
        which = np.repeat(np.arange(len(anchors)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return which, self.places[np.repeat(self.first[terms], n) + within]

    def exact(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase matches: first and last place in the shard, and the item."""
        anchors = np.unique(self.rarest(q))
        which, at = self.candidates(q, anchors)
        mine = anchors[which]
        reach = [np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)]
        for side, step in enumerate((-1, 1)):
            alive = np.arange(len(at))
            for d in range(1, WINDOW):
                alive = alive[self.posted(q.flat[mine[alive] + step * d], at[alive] + step * d)]
                if not len(alive):
                    break
                reach[side][alive] = d
        hit = np.flatnonzero(reach[0] + reach[1] + 1 >= q.need[mine])
        return at[hit] - reach[0][hit], at[hit] + reach[1][hit], q.item_of[mine[hit]]

    def tries(self, q: Queries, share: float):
        """Windows and anchors for ``near``, some at a time: the place of a window, the place of one of its terms, and the words that must be found.

        Of a window that may miss n words, n + 1 are anchors: one of any so many must be found. The rarest give the least work; which they are doesn't change what is found.
        """
        counts = self.count[q.flat]
        for size, every in q.windows.items():
            least = max(1, int(np.ceil(share * size - 1e-9)))
            if least > size:
                continue
            for i in range(0, len(every), _TRIED):
                at = every[i : i + _TRIED]
                seen = np.lib.stride_tricks.sliding_window_view(counts, size)[at]
                pick = np.argsort(seen, axis=1, kind="stable")[:, : size - least + 1]
                places, anchors = np.repeat(at, pick.shape[1]), (at[:, None] + pick).ravel()
                there = counts[anchors] > 0
                places, anchors = places[there], anchors[there]
                total = np.cumsum(counts[anchors])
                a = 0
                while a < len(anchors):
                    b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _TRIED, "right")))
                    yield places[a:b], anchors[a:b], least
                    a = b

    def near(self, q: Queries, slop: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proximity matches: windows that can be laid on a document so that at least ``share`` of their words lie within ``slop`` places of where they should.

        A window may stick out of the document; words of other documents don't count. A match reaches from the first to the last word found.
        """
        hits = [np.zeros((3, 0), np.int64)]
        for windows, anchors, least in self.tries(q, share):
            which, at = self.candidates(q, anchors)
            doc = np.searchsorted(self.starts, at, "right") - 1
            low, high = self.starts[doc], self.starts[doc + 1] - 1
            place = windows[which]
            size = int(q.need[place[0]])
            for shift in range(-slop, slop + 1):
                start = at - (anchors - windows)[which] - shift
                alive, found = np.arange(len(at)), np.zeros(len(at), np.int64)
                first, last = np.full(len(at), high.max()), np.full(len(at), -1)
                for k in range(size):
                    term, there = q.flat[place[alive] + k], np.zeros(len(alive), bool)
                    for d in range(-slop, slop + 1):
                        p = start[alive] + k + d
                        same = (p >= low[alive]) & (p < high[alive])
                        same[same] = self.posted(term[same], p[same])
                        there |= same
                        mine, p = alive[same], p[same]
                        first[mine], last[mine] = np.minimum(first[mine], p), np.maximum(last[mine], p)
                    found[alive] += there
                    alive = alive[found[alive] + size - k - 1 >= least]
                hits.append(np.unique(np.stack([first[alive], last[alive], q.item_of[place[alive]]]), axis=1))
        first, last, item = np.unique(np.concatenate(hits, axis=1), axis=1)
        return first, last, item


FOUND = "doc_id long, digest binary, n_words long, spans array<int>, items array<long>"


def search(index: DataFrame, items: tuple, slop: int | None = None, share: float = 0.8) -> DataFrame:
    """Per document of the index: doc_id, digest, n_words, spans (flat list of first and last hit word) and the distinct items found.

    The digest is the beginning of the text's SHA-256. With ``slop``,
    proximity matches are sought instead of phrases.
    """

    def run(batches):
        q = queries(items)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, digests, *arrays = (batch.column(k)[row].values for k in range(6))
                shard = Shard(q, *(x.to_numpy(zero_copy_only=False) for x in arrays))
                first, last, item = shard.exact(q) if slop is None else shard.near(q, slop, share)
                n = len(ids)
                doc = np.searchsorted(shard.starts, first, "right") - 1
                spans: dict[int, set] = {}
                found: dict[int, set] = {}
                for d, a, b, i in zip(doc.tolist(), (first - shard.starts[doc]).tolist(), (last - shard.starts[doc]).tolist(), item.tolist(), strict=True):
                    spans.setdefault(d, set()).add((a, b))
                    found.setdefault(d, set()).add(q.ids[i])
                flat = [[x for s in sorted(spans[d]) for x in s] if d in spans else [] for d in range(n)]
                listed = [sorted(found[d] - {None}) if d in found else [] for d in range(n)]
                words_of = pa.array(np.diff(shard.starts) - 1, pa.int64())
                columns = [ids, digests, words_of, pa.array(flat, pa.list_(pa.int32())), pa.array(listed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_words", "spans", "items"])

    return common.in_batches(index, run, FOUND)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items, collected block by block; each block holds about ``block_bytes`` of text at most."""
    chosen = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + int(total * 1.1) // block_bytes
    for k in range(n):
        yield tuple((r.i, r.t.encode()) for r in chosen.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k).orderBy("i", "t").collect())


def matches(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", slop: int | None = None, share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: the columns of ``search``, over all items. The corpus is read once, to be indexed."""
    index, _ = common.stored(build_index(docs, id_col, text_col), "postings")
    parts = [search(index, items, slop, share) for items in _blocks(benchmark, item_col, "text", block_bytes)]
    if len(parts) == 1:
        return parts[0]
    parts = [common.stored(p, "found")[0] for p in parts]
    every = parts[0].select("doc_id", "digest", "n_words")
    some = parts[0]
    for p in parts[1:]:
        some = some.unionByName(p)
    some = some.where(F.size("spans") > 0).distinct().groupBy("doc_id", "digest")
    some = some.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    some = some.withColumnsRenamed({"doc_id": "_d", "digest": "_g"})
    both = every.join(some, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g")), "left")
    return both.select("doc_id", "digest", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", "array<int>"), ("items", "array<long>"))))


def _without(docs: DataFrame, items: tuple, text_col: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches):
        q = queries(items)
        for batch in batches:
            shard = Shard(q, *_postings(batch.column(at)))
            clean = np.ones(batch.num_rows, bool)
            clean[np.searchsorted(shard.starts, shard.exact(q)[0], "right") - 1] = False
            yield batch.filter(pa.array(clean))

    return common.in_batches(docs, run, docs.schema, rows=SHARD_ROWS)


def without(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in whose texts no window of any item occurs.

    Rows are judged where they are read, a shard at a time. Each further block
    of items reads the rows that are left once more, from the shared folder.
    """
    path = None
    for k, items in enumerate(_blocks(benchmark, item_col, "text", block_bytes)):
        if k:
            before = path
            docs, path = common.stored(docs, "clean")
            if before:
                common.remove(docs.sparkSession, before)
        docs = _without(docs, items, text_col)
    return docs


def covered(spans: list[int]) -> int:
    """Words inside the spans."""
    total, reached = 0, -1
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, reached + 1) + 1)
        reached = max(reached, b)
    return total


def judged(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from what ``matches`` returns."""
    nothing = sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_hit = [covered(s) if s else 0 for s in spans]
            digests = [sha256(",".join(sorted(map(str, i))).encode()).hexdigest() if i else nothing for i in items]
            columns = [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    rows = common.in_batches(found.select("doc_id", "n_words", "spans", "items"), run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return rows.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    return judged(matches(docs, benchmark, **options))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents
), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark
), q AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), s AS (SELECT DISTINCT size FROM q
), w AS (
  SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, s WHERE len(ws) >= size)
), m AS MATERIALIZED (SELECT w.rid, w.i, w.size, q.item_id FROM w JOIN q ON w.size = q.size AND w.g = q.g
), h AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, size)) AS k FROM m) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, (COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLE = {"op9_benchmark_decontamination": SQL}
