"""Quality rules: a threshold table compiled into Spark projections.

Every metric is a built-in expression over one row, so the scan feeds the
verdict without a shuffle or a user function. The only intermediate columns
are the words of the text and the hashes of its word windows.

Nulls count as the empty text, which fails the base rule. Repeated rows are
judged row by row. Other columns of the input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8

STOP_WORDS = tuple(
    "the of and to in is was that for on with as by at be this are from or an it a which have not "
    "el la los las de del en y que por para con un una es se su al lo como más no "
    "le les des du et à au aux une dans pour qui sur pas par ne il elle est avec ce sont "
    "der die das und ist von den dem ein eine zu mit im für auf nicht sich als auch des er sie werden "
    "il lo gli di che non sono della dei nel alla più anche o os as do da dos das em uma não mais ao foi "
    "het een van op te dat niet zijn voor met ook aan bij w z na się nie do jest że och att det som på är av den till inte "
    "og er ikke ve bir bu için ile de da и в не на что с по как это к из у за а се și nu la în este pe cu yang dan di itu dengan untuk".split()
)


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie between ``low`` and ``high``, both included; None: no bound on that side."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The metrics are ratios of the counts that ``counts`` makes.
METRICS = {
    "mean_word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "stop_word_ratio": "n_stop_words / n_words",
    "duplicate_line_ratio": "n_dup_lines / n_lines",
    "repeated_word_ratio": "n_repeat_words / n_words",
}

RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_ratio", 0.04, None),
    Rule("duplicate_line_ratio", None, 0.4),
)


def _paired(width: int):
    return lambda i: F.xxhash64(F.get(F.col("_h"), i), F.get(F.col("_h"), i + width))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words.

    n_repeat_words counts the words inside an 8-word window that is found
    twice or more in the text. Window hashes show whether there is any; if so,
    windows are compared by 128 bits of hash, sorted, and their union measured.
    """
    n = F.size("_w")
    step = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    step = step.select(id_col, "_t", F.array_remove(F.split("_t", SPACE), "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    step = step.select(id_col, "_t", "_w", lines.alias("_l"))
    plain = [
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    ]
    step = step.select(id_col, *plain, "_w", F.when(n >= WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"))
    done = [id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    for width in (1, 2, 4):  # hashes of 2, 4 and 8 words, each from two of half the width
        pairs = F.transform(F.sequence(F.lit(0), F.size("_h") - (width + 1)), _paired(width))
        step = step.select(*done, "_w", F.when(F.col("_h").isNotNull(), pairs).alias("_h"))
    keys = F.transform(
        F.sequence(F.lit(0), F.size("_h") - 1),
        lambda i: F.struct(F.get(F.col("_h"), i).alias("a"), F.xxhash64(F.slice(F.col("_w"), i + 1, WINDOW)).alias("b"), i.alias("i")),
    )
    step = step.select(*done, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(keys)).alias("_k"))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])
    again = F.transform(
        "_k",
        lambda x, k: F.when(
            F.coalesce(same(x, F.get(F.col("_k"), k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(F.col("_k"), k + 1)), F.lit(False)),
            x["i"],
        ),
    )
    step = step.select(*done, F.sort_array(F.array_compact(again)).alias("_s"))
    new = F.transform("_s", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_s"), k + 1) - v, F.lit(WINDOW))))
    covered = F.aggregate(new, F.lit(0), lambda a, x: a + x)
    return step.select(*done, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def passes(rules=RULES) -> Column:
    """The rules as one boolean expression over the counts; a ratio over nothing breaks no rule."""
    verdict = F.lit(True)
    for r in rules:
        value = F.expr("try_divide({}, {})".format(*METRICS[r.metric].split(" / ")))
        if r.low is not None:
            verdict &= F.coalesce(value >= r.low, F.lit(True))
        if r.high is not None:
            verdict &= F.coalesce(value <= r.high, F.lit(True))
    return verdict


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every text with base_failed and kept."""
    found = counts(docs, id_col, text_col)
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _sql_rules(rules=RULES) -> str:
    parts = []
    for r in rules:
        a, b = METRICS[r.metric].split(" / ")
        value = f"({a} / NULLIF({b}, 0))"
        parts += [f"COALESCE({value} >= {r.low}, true)"] if r.low is not None else []
        parts += [f"COALESCE({value} <= {r.high}, true)"] if r.high is not None else []
    return " AND ".join(parts)


SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), c AS (
  SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM w
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, n_words - 6)) AS i FROM c WHERE n_words >= 8)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), s AS (
  SELECT rid, CAST(sum(least(8, COALESCE(nxt - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid
), a AS (
  SELECT c.*, COALESCE(s.n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN s USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_sql_rules()}) AS kept,
       n_lines, n_stop_words
FROM a
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE = {"op4_quality_rules": SQL}
