"""URL filters over a sorted, memory-mapped digest array.

A rule is a host, a path and a verdict. It fits URLs of its host and of all
subdomains whose path starts with the rule's path; of several that fit, the
longest host and path decide, of equally long ones the longest host. The
rules are sorted by the 64-bit xxhash of host and path and lie in files of a
range of digests each: the sorted digests, the ends of the strings, and the
full strings. Executors write the files, every executor maps them; pages of
the mapping are shared by its workers and can be dropped under memory
pressure, so the list may be larger than memory. Each executor keeps the files
on its own disk.

A URL is probed with every suffix of its host at a label and every prefix of
its path that is as long as some rule's. All probes of a batch are sought by
one binary search; digests that are found count only if the stored string is
equal too, so collisions change nothing. URLs that no rule fits are allowed.

A null URL, or one without "://", has an empty host and path, which no rule
fits. Rows that repeat are judged row by row. Of rules that repeat a host and
path, a blocking one wins. Other columns of the pages are never read. A table
without pages gives none, one without rules allows all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401 - it is not loaded with pyarrow
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common

ALLOW, BLOCK = "allow", "block"
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """Columns: host and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def key(host: str, path: str) -> str:
    """What is hashed: no other host and path give the same."""
    return f"{len(host)}:{host}{path}"


@dataclass(frozen=True)
class Ranges:
    """The files of the index in order, the least digest of each, and the lengths of the rules' paths."""

    files: tuple[str, ...]
    least: tuple[int, ...]
    lengths: tuple[int, ...]


def write_index(rules: DataFrame, rules_a_file: int = 1 << 20) -> Ranges:
    """``rules``: host, path, verdict.

    Spark sorts the rules into ranges of digests; the executors write a file
    for each range into the shared folder, and fetch them from there. What the
    driver sees of a file is its name and its least digest. A file of a task
    that was run again has a name of its own; the one in the result counts.
    """
    spark = rules.sparkSession
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where("host IS NOT NULL AND host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))

    def digest(batches):
        for b in batches:
            keys = list(map(key, b.column(0).to_pylist(), b.column(1).to_pylist()))
            digests = [xxhash.xxh64_digest(k) for k in keys]
            lengths = [len(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.string()), b.column(2), pa.array(lengths, pa.int32())], names=["d", "k", "v", "n"])

    keyed, path = common.stored(common.in_batches(rules, digest, "d binary, k string, v string, n int", rows=4096), "url-rules")
    folder = common.made_folder(spark, "urls")

    def write(batches):
        digests, texts = [], []
        for b in batches:
            digests += b.column(0).to_pylist()
            texts += [(b"+" if v == ALLOW else b"-") + k.encode() for k, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if digests:
            name = f"{uuid.uuid4().hex}.urls"
            files, at = pa.fs.FileSystem.from_uri(folder)
            with files.open_output_stream(f"{at}/{name}") as out:
                out.write(np.array([len(digests)], "<u8").tobytes())
                out.write(np.frombuffer(b"".join(digests), ">u8").astype("<u8").tobytes())
                out.write(np.cumsum([len(t) for t in texts], dtype="<u8").tobytes())
                out.write(b"".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digests[0]], pa.binary())], names=["name", "least"])

    n = max(1, -(-keyed.count() // rules_a_file))
    found = common.in_batches(keyed.repartitionByRange(n, "d").sortWithinPartitions("d", "k"), write, "name string, least binary", rows=4096)
    found = sorted((r.least, r.name) for r in found.collect())
    for _, name in found:
        spark.sparkContext.addFile(f"{folder}/{name}")
    lengths = sorted(r.n for r in keyed.select("n").distinct().collect())
    common.remove(spark, path)
    return Ranges(tuple(name for _, name in found), tuple(int.from_bytes(d, "big") for d, _ in found), tuple(lengths))


class File:
    """One range of the index, mapped."""

    def __init__(self, path: str) -> None:
        n = int(np.fromfile(path, "<u8", 1)[0])
        self.digests, self.ends = np.memmap(path, "<u8", "r", 8, n), np.memmap(path, "<u8", "r", 8 + 8 * n, n)
        self.strings = np.memmap(path, "u1", "r", 8 + 16 * n)

    def verdicts(self, keys: list[str], sought: np.ndarray) -> dict[str, str]:
        """Verdicts of the keys, whose digests are ``sought``, that are in the file."""
        found: dict[str, str] = {}
        at = np.searchsorted(self.digests, sought)
        inside = np.flatnonzero(at < len(self.digests))
        for j in inside[self.digests[at[inside]] == sought[inside]].tolist():
            i, wanted = int(at[j]), keys[j].encode()
            while i < len(self.digests) and self.digests[i] == sought[j]:  # equal digests lie side by side
                text = self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()
                if text[1:] == wanted:
                    found[keys[j]] = ALLOW if text[:1] == b"+" else BLOCK
                    break
                i += 1
        return found


class Index:
    """All ranges, each mapped when first probed."""

    def __init__(self, ranges: Ranges) -> None:
        self.least, self.ranges, self.files = np.array(ranges.least, np.uint64), ranges, {}

    def find(self, keys: list[str]) -> dict[str, str]:
        """Verdicts of the keys that are in the list."""
        found: dict[str, str] = {}
        if not keys or not len(self.least):
            return found
        sought = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        of = np.searchsorted(self.least, sought, "right").astype(np.int64) - 1
        for r in np.unique(of[of >= 0]).tolist():
            if r not in self.files:
                self.files[r] = File(SparkFiles.get(self.ranges.files[r]))
            mine = np.flatnonzero(of == r)
            found.update(self.files[r].verdicts([keys[k] for k in mine.tolist()], sought[mine]))
        return found


@lru_cache(maxsize=4)
def opened(ranges: Ranges) -> Index:
    return Index(ranges)


def probes(host: str, path: str, lengths: tuple[int, ...]) -> list[tuple[str, str]]:
    """The keys that could fit and how each is shown, in order of decision: longest first, then longest host."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [h for k in range(len(labels)) if (h := ".".join(labels[k:]))]
    keys = [(len(h) + n, len(h), key(h, path[:n]), h + path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [(k, shown) for _, _, k, shown in sorted(keys, reverse=True)]


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits) and verdict."""
    ranges = write_index(rules)

    def run(batches):
        index = opened(ranges)
        for b in batches:
            tried = [probes(h, p, ranges.lengths) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            found = index.find(list(dict.fromkeys(k for keys in tried for k, _ in keys)))
            hits = [next(((k, shown) for k, shown in keys if k in found), (None, None)) for keys in tried]
            verdicts = [found.get(k, ALLOW) for k, _ in hits]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shown for _, shown in hits], pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = parts(F.col(url_col))
    chosen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return common.in_batches(chosen, run, f"page_id {chosen.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = rf"""
WITH r(rhost, rpath, v) AS (VALUES {_VALUES}
), u AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS MATERIALIZED (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT rid, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, COALESCE(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE = {"op10_url_filter": SQL}
