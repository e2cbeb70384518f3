"""Language ID by bit-sliced Bloom filters of n-grams.

A model has one Bloom filter per language, stored bit-sliced: slot s holds,
in one machine word, bit s of every language's filter. Ands of the slots that
an n-gram hashes to give the set of all languages that contain it, in as many
probes as one filter takes. Per language, set bits are counted over a text's
n-grams and corrected for the filter's own rate of false positives; the largest
corrected count decides, the first name in order winning ties.

N-grams are four bytes of UTF-8 around each letter byte, A-Z lower-cased;
ASCII other than letters counts as a space. Languages are learned from a
bounded sample, ``per_language`` texts of each.

Null texts and texts without a letter are ``und`` with score 0. A text none of
whose n-grams is known gets the first language with score 0. Rows that repeat
are judged row by row. Without labelled rows every text is ``und``. A table
without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsheet.llm import common

UNDETERMINED = "und"
N = 4
_PAD = b"   "
_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_PROBES = np.random.default_rng(5).integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Sampled ids that are broadcast, at most: those of 200 languages.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class Settings:
    """An n-gram belongs to a language if at least ``min_share`` of its sampled texts have it, two at least,
    and that share is at least ``relative`` of the largest share among languages. Filters have 2^``slot_bits`` slots, or
    more if a language's n-grams would fill over a third of them."""

    per_language: int = 1000
    min_share: float = 0.004
    relative: float = 0.2
    slot_bits: int = 18


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]  # one per 64 languages
    false_rate: np.ndarray  # by language
    slot_bits: int


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts in order, and where each text's begin (len + 1)."""
    parts = [t or b"" for t in texts]
    data = _MAP[np.frombuffer(_PAD + _PAD.join(parts) + _PAD, np.uint8)]
    wide = data.astype(np.uint32)
    grams = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    at = np.flatnonzero(data[1:-2] != 32)
    ends = np.cumsum([0, *(len(p) + len(_PAD) for p in parts)])
    return grams[at], np.searchsorted(at, ends)


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    wide = grams.astype(np.uint64) + np.uint64(1)
    return [((wide * p) >> np.uint64(64 - bits)).astype(np.int64) for p in _PROBES]


def build(shares: list[tuple[str, np.ndarray]], slot_bits: int) -> Model:
    """``shares``: each language with its n-grams. ``slot_bits``: the least size of the filters."""
    shares = sorted(shares, key=lambda x: x[0])
    most = max((len(g) for _, g in shares), default=0)
    slot_bits = max(slot_bits, int(np.ceil(np.log2(3 * len(_PROBES) * max(1, most)))))
    tables, rates = [], []
    for a in range(0, len(shares), 64):
        part = shares[a : a + 64]
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(part) <= n)
        table = np.zeros(1 << slot_bits, kind)
        for k, (_, grams) in enumerate(part):
            for s in _slots(grams, slot_bits):
                table[s] |= kind(1 << k)
        tables.append(table)
        rates += [float(((table >> kind(k)) & kind(1)).mean()) ** len(_PROBES) for k in range(len(part))]
    return Model(tuple(x for x, _ in shares), tuple(tables), np.array(rates), slot_bits)


def fit(labelled: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows with a text, a language and an id. What is collected, the n-grams of the filters, is bounded by ``per_language`` texts of each language."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = rows.select("i", "l").withColumn("k", F.row_number().over(order)).where(F.col("k") <= settings.per_language)
    chosen, chosen_path = common.stored(chosen.select("i", "l").distinct(), "chosen-texts")
    # So that no text is shuffled to find a few; with very many languages Spark decides.
    few = F.broadcast(chosen) if chosen.count() <= MOST_BROADCAST else chosen
    sample = rows.join(few, ["i", "l"], "left_semi").select("l", "t")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            grams, first = _grams(batch.column(1).cast(pa.large_binary()).to_pylist())
            of = np.repeat(np.arange(len(langs)), np.diff(first))
            for lang in set(langs):
                mine = np.flatnonzero(langs == lang)
                use = np.isin(of, mine)
                pairs = np.unique((of[use].astype(np.uint64) << np.uint64(32)) | grams[use])
                found, n = np.unique(pairs & np.uint64(0xFFFFFFFF), return_counts=True)
                found, n = np.append(found.astype(np.int64), -1), np.append(n, len(mine))  # -1: the texts themselves
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(found), pa.array(n, pa.int64())], names=["l", "g", "n"])

    counts = common.in_batches(sample, count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).where("n > 1 OR g = -1")
    counts, path = common.stored(counts, "n-grams")
    texts = counts.where("g = -1").select("l", F.col("n").alias("texts"))
    share = counts.where("g >= 0").join(texts, "l").select("l", "g", (F.col("n") / F.col("texts")).alias("share"))
    top = F.max("share").over(Window.partitionBy("g"))
    used = share.withColumn("top", top).where((F.col("share") >= settings.min_share) & (F.col("share") >= settings.relative * F.col("top")))
    found = used.groupBy("l").agg(F.collect_list("g").alias("g")).collect()
    grams = {r.l: r.g for r in found}
    languages = sorted(r.l for r in texts.collect())
    for p in (path, chosen_path):
        common.remove(labelled.sparkSession, p)
    return build([(lang, np.array(sorted(grams.get(lang, ())), np.uint32)) for lang in languages], settings.slot_bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, lang_pred, score, and the columns in ``keep``. The score is the corrected share of n-grams that the language knows.

    A column in ``keep`` that is named like one of the others gets a leading underscore.
    """

    def run(batches):
        for batch in batches:
            langs, scores = decide(model, batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text_"), *common.kept(keep, ("doc_id", "lang_pred", "score", "_text_")))
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:])
    return common.in_batches(chosen, run, f"doc_id {chosen.schema[0].dataType.simpleString()}, lang_pred string, score double{kinds}")


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    grams, first = _grams([t.encode() if t else None for t in texts])
    n = np.diff(first)
    counts = []
    slots = _slots(grams, model.slot_bits)
    for t, table in enumerate(model.tables):
        masks = table[slots[0]]
        for s in slots[1:]:
            masks &= table[s]
        for k in range(min(64, len(model.languages) - 64 * t)):
            total = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(k)) & masks.dtype.type(1), dtype=np.int64)])
            counts.append(total[first[1:]] - total[first[:-1]])
    if not counts:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    rate = model.false_rate[:, None]
    right = np.clip((np.array(counts) - rate * n) / np.maximum(1 - rate, 1e-9), 0, None)
    best = right.argmax(axis=0)
    score = np.clip(right[best, np.arange(len(texts))] / np.maximum(n, 1), 0, 1)
    lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def held_out(id_col: str = "doc_id", of: int = 4, rest: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == rest, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE: dict[str, str] = {}
