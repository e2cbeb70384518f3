"""MinHash near-duplicate detection with exact confirmation.

Plan:

1. One pass over the texts makes each row's shingle set, the digest of that
   set, and ``bands * rows`` universal hash minima. Rows with equal digests
   are one node, so a thousand exact copies are carried as one row from then on.
2. Minima are banded. Every node of a bucket is paired with the bucket's
   smallest node only: a bucket of n nodes gives n - 1 pairs.
3. Pairs are verified, first on the signatures, then on the full sets of their
   texts. Links give components (large-star, small-star).
4. Nodes of buckets that still hold several components are compared across
   components by an exact join on their rarest shingles (see ``across``), so no
   pair of nodes that shares a bucket stays unchecked unless its nodes are
   connected already or its sets are too unlike to be linked.

Null texts and texts without words have an empty set and are linked with
nothing. A row gets the component of its own text's set. Rows of one doc_id
with different texts are one node where no smaller doc_id has such a set; a
pair of nodes is linked if any of their texts are similar enough. A null
doc_id stands for no set but can be a copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common, vector
from loomsheet.llm.components import components


@dataclass(frozen=True)
class Settings:
    """At a similarity of 0.8, the default bands miss a pair with probability (1 - 0.8^5)^36 < 1e-6.

    ``per_cent`` is the least similarity of a link. ``slack`` is how far below
    it a signature's estimate may lie before the pair is dropped unconfirmed:
    0.2 is over six standard deviations of 180 minima.
    """

    shingle_words: int = 5
    per_cent: int = 80
    bands: int = 36
    rows: int = 5
    slack: float = 0.2
    seed: int = 11


def _minima(sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes (a x + b) mod 2^64 over one set, upper 32 bits."""
    low = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(sets), 1024):
        values = np.multiply.outer(a, sets[i : i + 1024])
        values += b[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_shingles, key (digest of the set, null if empty), signature (a byte per minimum), bits (the lowest bit of each, packed), buckets (a hash per band)."""
    rng = np.random.default_rng(s.seed)
    n = s.bands * s.rows
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    weights = rng.integers(0, 1 << 63, (s.bands, s.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("signature", pa.binary()), ("bits", pa.list_(pa.int64())), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signs, bits, buckets = [], [], [], [], []
            for found in vector.shingle_sets(batch.column(1), s.shingle_words):
                sizes.append(len(found))
                if not len(found):
                    keys.append(None)
                    signs.append(None)
                    bits.append(None)
                    buckets.append(None)
                    continue
                keys.append(blake2b(found.tobytes(), digest_size=16).digest())
                low = _minima(found, a, b)
                signs.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                bits.append(np.packbits(np.pad((low & np.uint32(1)).astype(np.uint8), (0, -n % 64))).view(np.int64))
                sums = (low.reshape(s.bands, s.rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                buckets.append(vector.mix(sums + np.arange(s.bands, dtype=np.uint64)).view(np.int64))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(buckets, pa.list_(pa.int64()))], schema=out)

    types = "doc_id long, n_shingles long, key binary, signature binary, bits array<long>, buckets array<long>"
    return common.in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, types)


def _alike(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (x, y) whose signatures agree in at least the share that the threshold less the slack gives."""
    least = int((s.per_cent / 100 - s.slack) * s.bands * s.rows)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    sign = nodes.select("node", "signature")
    both = common.hot_lookup(pairs, sign.toDF("y", "sy"), "y", "x")
    both = both.join(sign.toDF("x", "sx"), "x")
    return common.in_batches(both.select("x", "y", "sx", "sy"), run, "x long, y long")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (x, y) whose full shingle sets are similar enough. Neither a hot x nor a hot y stays in one task."""

    def run(batches):
        for batch in batches:
            every = [c.values.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            at = [c.offsets.to_numpy() for c in batch.columns[2:]]
            keep = []
            for k in range(batch.num_rows):
                x, y = (v[o[k] : o[k + 1]] for v, o in zip(every, at, strict=True))
                if 100 * min(len(x), len(y)) < s.per_cent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                both = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * both >= s.per_cent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sets = sets.select("node", "shingles")
    both = common.hot_lookup(pairs, sets.toDF("y", "ty"), "y", "x", hot_rows=1000)
    both = common.hot_lookup(both, sets.toDF("x", "tx"), "x", "y", hot_rows=1000, counts=pairs.groupBy("x").count())
    return common.in_batches(both.select("x", "y", "tx", "ty"), run, "x long, y long")


#: Sets in one slice of those that share a shingle.
SLICE = 1000


def across(shared: DataFrame, comps: DataFrame, nodes: DataFrame, sets: DataFrame, s: Settings, keep=lambda df, name: common.stored(df, name)[0], slice_rows: int = SLICE) -> DataFrame:
    """Pairs (x, y) of nodes in different components that may be similar enough, of nodes whose buckets hold several components.

    No bucket is multiplied out. Two sets as similar as ``per_cent`` asks have
    one shingle in common among the rarest of each, as many as such a set may
    lack and one more; so sets meet on those shingles only. Shingles that one
    set alone has, which is most of them where texts differ, meet nothing. Of
    sets that share a shingle, those of unlike sizes and those whose
    signatures' lowest bits differ too often are not paired. A shingle of very
    many sets is cut into slices, which meet slice by slice in tasks of their own.
    """
    n = s.bands * s.rows
    # Two sets at the threshold agree in this many bits less once in a thousand million times at most: six standard deviations.
    agree = (1 + s.per_cent / 100) / 2
    least = int(n * agree - 6.5 * (n * agree * (1 - agree)) ** 0.5)
    placed = shared.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    left = common.hot_lookup(placed, mixed, "bucket", "node", "left_semi").select("node", "component").distinct()
    rows = sets.join(left, "node").join(nodes.groupBy("node").agg(F.min("bits").alias("bits")), "node")
    rows = keep(rows.select("node", "key", "component", "bits", F.size("shingles").alias("n"), "shingles"), "left-over")
    words = rows.select("node", "key", F.explode("shingles").alias("w"))
    often = keep(words.groupBy("w").count().where("count > 1"), "frequent")
    found = common.hot_lookup(words, often, "w", "node", counts=often)
    found = found.groupBy("node", "key").agg(F.sort_array(F.collect_list(F.struct("count", "w"))).alias("t"))  # at most one text's shingles
    found = rows.drop("shingles").join(found, ["node", "key"])
    may_lack = F.expr(f"n - CAST((CAST(n AS LONG) * {s.per_cent} + 99) DIV 100 AS INT)")
    first = F.slice("t", 1, F.greatest(may_lack + 1 - (F.col("n") - F.size("t")), F.lit(0)))
    found = found.select("node", "component", "bits", "n", F.explode(first).alias("t")).select("node", "component", "bits", "n", "t.w", F.ceil(F.col("t.count") / slice_rows).cast("int").alias("_of"))
    found = keep(found.withColumn("_at", F.pmod(F.xxhash64("node"), F.col("_of")).cast("int")), "rarest")
    side = lambda c, i, j: found.select("w", i, j, *(F.col(k).alias(f"{k}_{c}") for k in ("node", "component", "bits", "n")))
    x = side("x", F.col("_at").alias("_i"), F.explode(F.sequence("_at", F.col("_of") - 1)).alias("_j"))
    y = side("y", F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("_i"), F.col("_at").alias("_j"))
    same = sum((F.bit_count(F.get("bits_x", F.lit(k)).bitwiseXOR(F.get("bits_y", F.lit(k)))) for k in range(-(-n // 64))), F.lit(0))
    met = F.expr(f"component_x <> component_y AND (_i < _j OR node_x > node_y) AND 100L * least(n_x, n_y) >= {s.per_cent}L * greatest(n_x, n_y)") & (same <= n - least)
    pairs = x.join(y, ["w", "_i", "_j"]).where(met)
    return pairs.select(F.greatest("node_x", "node_y").alias("x"), F.least("node_x", "node_y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id is the component's smallest)."""
    s = settings
    signed, _ = common.stored(signatures(docs, s, id_col, text_col), "signatures")
    keyed = signed.where("key IS NOT NULL")
    heads = keyed.groupBy("key").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    heads, _ = common.stored(heads, "heads")
    nodes = keyed.join(heads.withColumnRenamed("node", "doc_id"), ["key", "doc_id"], "left_semi").withColumnRenamed("doc_id", "node")
    nodes = nodes.select("node", "signature", "bits", "buckets")
    banded = nodes.select("node", F.explode("buckets").alias("bucket"))
    # Buckets of one node are of no further use; what is left is a small part of all.
    least = banded.groupBy("bucket").agg(F.min("node").alias("y"), F.max("node").alias("z")).where("y < z")
    with common.scratch(docs.sparkSession) as keep:
        shared = keep(banded.join(least.select("bucket", "y"), "bucket").distinct(), "buckets")
        ours = shared.select("node").distinct()
        nodes = keep(nodes.join(ours, "node", "left_semi").select("node", "signature", "bits").distinct(), "nodes")
        sets = keep(_sets_of(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")), ours, s), "sets")

        def confirmed(pairs: DataFrame, name: str) -> DataFrame:
            alike = keep(_alike(keep(pairs, name + "-pairs"), nodes, s), name + "-alike")
            return keep(_confirmed(alike, sets, s).distinct(), name)

        links = confirmed(shared.where("node <> y").select(F.col("node").alias("x"), "y").distinct(), "links")
        comps = components(links)
        further = confirmed(across(shared.select("node", "bucket"), comps, nodes, sets, s, keep), "more-links")
        if not further.isEmpty():
            comps = components(links.unionByName(further))
    found = heads.join(comps, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    rows = common.hot_lookup(signed.select("doc_id", "n_shingles", "key"), found, "key", "doc_id", "left")
    rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _sets_of(texts: DataFrame, ours: DataFrame, s: Settings) -> DataFrame:
    """node, key and the sorted shingles of every text of the nodes in ``ours``, equal sets of a node once."""

    def run(batches):
        for batch in batches:
            sets = list(vector.shingle_sets(batch.column(1), s.shingle_words))
            keys = [blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), lists], names=["node", "key", "shingles"])

    found = common.in_batches(texts.join(ours, "node", "left_semi"), run, "node long, key binary, shingles array<long>")
    return found.groupBy("node", "key").agg(F.first("shingles").alias("shingles")).where("size(shingles) > 0")


CONTRACT = Settings(shingle_words=2)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), CONTRACT)


#: Shingle pairs by size and prefix: 100 * common >= 80 * either needs a common shingle among the rarest fifth of each set.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                               WHEN len(ws) = 1 THEN ws ELSE [] END) AS s FROM d)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), f AS (SELECT s, count(*) AS df FROM g GROUP BY s
), p AS MATERIALIZED (
  SELECT doc_id, s, n FROM (
    SELECT g.doc_id, g.s, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY f.df, g.s) AS k FROM g JOIN f USING (s) JOIN n USING (doc_id))
  WHERE k <= n - (80 * n + 99) // 100 + 1
), c AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny
  FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), l AS MATERIALIZED (
  SELECT x, y FROM (
    SELECT c.x, c.y, any_value(nx) AS nx, any_value(ny) AS ny, count(*) AS common FROM c JOIN g a ON a.doc_id = c.x JOIN g b ON b.doc_id = c.y AND a.s = b.s GROUP BY 1, 2)
  WHERE 100 * common >= 80 * (nx + ny - common)
), e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT x AS doc_id, x AS root FROM (SELECT DISTINCT x FROM e)
  UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(m.root, d.doc_id) AS component_id, COALESCE(m.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
ORACLE = {"op5_minhash_near_dedup": SQL}
