"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges of a pre-token are queued by rank: a bucket per merge rank holds
positions of a linked list of parts, and a bitmap of two levels says which
buckets are in use. Two find-first-set steps give the next rank, whatever
the length of the pre-token; entries that a neighbouring merge has made stale
are skipped. A pre-token of n bytes takes O(n log n) at worst, where scanning
for the best pair after every merge would take O(n^2).

Null is the empty text: no ids. Repeated rows are encoded row by row. Special
tokens are never made: their strings are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space as Unicode defines it. The regex module's \s also takes U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"

#: The longest pre-tokens, in characters, that a worker remembers, and how many in each of two generations; a hundred thousand take about 25 MB.
REMEMBERED_LENGTH, REMEMBERED = 40, 100_000


_BIT = [1 << k for k in range(256)]


class Encoder(dict):
    """Ids of pre-tokens, made when first asked for. ``raw``: lines of a base64 token and its rank.

    Remembered pre-tokens come in two generations. When the younger is full it
    becomes the older one, and what the older one held is forgotten unless it
    has been asked for since.
    """

    def __init__(self, raw: bytes, pattern: str, remembered: int = REMEMBERED) -> None:
        super().__init__()
        self.remembered = remembered
        self.older: dict[str, tuple[int, ...]] = {}
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines()) if t}
        if max(self.ranks.values(), default=0) >= 1 << 16:
            raise ValueError("the bitmaps hold ranks below 65536")
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.names = {r: str(r) for r in self.tokens}
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.merged(piece.encode()))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        ``top`` and ``low`` are the bitmap: bit a of ``top`` is set if any rank
        from 256 a to 256 a + 255 is queued, and ``low[a]`` says which ones.
        """
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair: list[int | None] = [None] * n  # the rank of the pair that starts here, if a part starts here
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    a = r >> 8
                    low[a] = low.get(a, 0) | _BIT[r & 255]
                    top |= _BIT[a]
        while top:
            first = top & -top
            a = first.bit_length() - 1
            word = low[a]
            bit = word & -word
            r = (a << 8) + bit.bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[a] = word ^ bit
                if word == bit:
                    top ^= first
            if pair[i] != r:
                continue  # stale: a neighbour has merged since
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = None
            new = None
            if end < n:
                before[end] = i
                new = get(piece[i : after[end]])
            pair[i] = new
            left = before[i]
            for at, new in ((i, new), (left, get(piece[left:end]) if left >= 0 else None)):
                if at == left and left >= 0:
                    pair[left] = new
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        a = new >> 8
                        low[a] = low.get(a, 0) | _BIT[new & 255]
                        top |= _BIT[a]
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : after[i]]))
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder(raw: bytes, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(raw, pattern, remembered)


def _vocabulary(path: str | None) -> tuple[bytes, str]:
    """The rank file, read once on the driver (under 1 MB) and sent to the executors; and the splitting pattern."""
    import public_tokenizers

    return Path(path or public_tokenizers.path(VOCABULARY)).read_bytes(), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Per row: doc_id, the columns in ``keep``, and ids (array of int); with ``decoded``, also decoded_sha256 of what the ids decode to.

    A column in ``keep`` that is named like one of the others gets a leading underscore.
    """
    raw, pattern = _vocabulary(path)

    def run(batches):
        ours = encoder(raw, pattern)
        for batch in batches:
            ids = [ours.encode(t or "") for t in batch.column(0).to_pylist()]
            back = [pa.array([sha256(ours.decode(i)).hexdigest() for i in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.list_(pa.int32())), *back], names=[*batch.schema.names[1:], "ids", *["decoded_sha256"] * decoded])

    chosen = docs.select(F.col(text_col).alias("_text_"), F.col(id_col).alias("doc_id"), *common.kept(keep, ("doc_id", "ids", "decoded_sha256")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return common.in_batches(chosen, run, f"{kinds}, ids array<int>" + ", decoded_sha256 string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded``: doc_id, ids. Returns doc_id and the decoded bytes; a null list decodes to nothing."""
    raw, pattern = _vocabulary(path)

    def run(batches):
        ours = encoder(raw, pattern)
        for batch in batches:
            out = [ours.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return common.in_batches(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", remembered: int = 5 * REMEMBERED) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256: the round trip without keeping the ids.

    Workers that do nothing else can remember more pre-tokens: by default up to a million, in about 250 MB.
    """
    raw, pattern = _vocabulary(path)

    def run(batches):
        ours = encoder(raw, pattern, remembered)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = ours.encode(text or "")
                shown = " ".join(map(ours.names.__getitem__, ids)).encode()
                rows.append((len(ids), sha256(shown).hexdigest(), sha256(ours.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.in_batches(chosen, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE: dict[str, str] = {}
