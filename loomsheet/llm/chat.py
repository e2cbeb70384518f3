"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A chat log often holds the same conversation again and again, each time a turn
longer. The scan gives every turn a 128-bit digest of its role and text. Every
place in a conversation hashes to 128 bits of place and digest; the running xor
of these is the hash of the conversation up to that turn. A conversation whose
last hash is a hash inside a longer one is a snapshot of it: an anti-join drops
it. Of equal conversations the smallest conv_id stays, one without a conv_id
only if none has any. Until then only digests are shuffled; the texts are
shuffled once, to be rendered.

A conversation is cut into blocks of ``BLOCK`` turn numbers, and each becomes a
part of its rendering. A block of over twice as many rows, as where turns have
the same number or none, is cut further, by number and by the first digits of
the digest; so a conversation of any length is spread over tasks.

Repeated rows count once. Turns without a number come first; turns with the
same number follow each other by digest. A null role or text differs from an
empty one, and is rendered as nothing. Rows without a conv_id form one
conversation. Other columns are never read. No turns give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsheet.llm import common

BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>"
_LEAST = -(1 << 63)
_CONVERSATION = ["c", "nul"]
_KEYS = [*_CONVERSATION, "tb", "t2", "pre"]


def _keyed(turns: DataFrame) -> DataFrame:
    """c and nul (conv_id and whether it is null), turn, digest, role, text, and the keys of the block: tb, t2, pre."""
    inside = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.coalesce("conv_id", F.lit(0).cast(kind)).alias("c"),
        F.col("conv_id").isNull().alias("nul"),
        "turn",
        F.unhex(F.substring(F.sha2(F.concat(inside("role"), inside("text")), 256), 1, 32)).alias("digest"),
        "role",
        "text",
        F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(_LEAST)).alias("tb"),
    ).withColumn("_b", F.xxhash64(*_CONVERSATION, "tb"))
    # Blocks with too many rows, and how many digits of the digest cut their largest turn number small enough.
    most = 2 * BLOCK
    counts, path = common.stored(rows.groupBy("_b", "turn").agg(F.count("*").alias("n")).groupBy("_b").agg(F.sum("n").alias("count"), F.max("n").alias("most")).where(F.col("count") > most), "chat-large")
    if counts.isEmpty():
        common.remove(rows.sparkSession, path)
        return rows.drop("_b").withColumns({"t2": F.lit(0).cast("long"), "pre": F.lit("")})
    large = counts.select("_b", F.when(F.col("most") > most, F.length(F.hex(F.expr(f"(most - 1) DIV {most}")))).otherwise(0).alias("_d"))
    rows = common.hot_lookup(rows, large, "_b", "digest", "left", counts=counts.select("_b", "count"))
    cut = F.col("_d").isNotNull()
    rows = rows.withColumns({"t2": F.when(cut, F.coalesce("turn", F.lit(_LEAST))).otherwise(0), "pre": F.when(cut, F.expr("substring(hex(digest), 1, _d)")).otherwise("")})
    return rows.drop("_b", "_d")


def _before(blocks: DataFrame, value: Column) -> Column:
    """A running value over the blocks of a conversation before this one."""
    return value.over(Window.partitionBy(*_CONVERSATION).orderBy("tb", "t2", "pre").rowsBetween(Window.unboundedPreceding, -1))


def _blocks(keyed: DataFrame) -> DataFrame:
    """A row a block: its keys, turns (number and digest, in order), part (from 0), before (turns in earlier blocks) and n_turns of the conversation."""
    made = keyed.groupBy(*_KEYS).agg(F.sort_array(F.collect_set(F.struct("turn", "digest"))).alias("turns"))
    made, _ = common.stored(made, "chat-blocks")
    every = Window.partitionBy(*_CONVERSATION)
    sizes = made.select(*_KEYS, F.size("turns").cast("long").alias("n"))
    sizes = sizes.select(*_KEYS, F.row_number().over(every.orderBy("tb", "t2", "pre")).alias("part"), F.coalesce(_before(sizes, F.sum("n")), F.lit(0)).alias("before"), F.sum("n").over(every).alias("n_turns"))
    return made.join(sizes.withColumn("part", (F.col("part") - 1).cast("long")), _KEYS)


def prefixes(blocks: DataFrame) -> DataFrame:
    """c, nul, place, n_turns, and h1, h2: the hash of the conversation up to that place."""
    at = lambda seed: F.transform("turns", lambda t, i: F.xxhash64(F.lit(seed), F.col("before") + i + 1, t["digest"]))
    hashed = blocks.select(*_KEYS, "before", "n_turns", at(17).alias("a1"), at(91).alias("a2"))
    whole = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    whole_blocks = hashed.select(*_KEYS, whole("a1").alias("w1"), whole("a2").alias("w2"))
    earlier = whole_blocks.select(*_KEYS, *(F.coalesce(_before(whole_blocks, F.bit_xor(w)), F.lit(0)).alias(f"e{w}") for w in ("w1", "w2")))
    rows = hashed.join(earlier, _KEYS).select(*_KEYS, "before", "n_turns", "ew1", "ew2", F.posexplode(F.arrays_zip("a1", "a2")).alias("i", "a"))
    order = Window.partitionBy(*_KEYS).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda k: F.col(f"ew{k}").bitwiseXOR(F.bit_xor(F.col(f"a.a{k}")).over(order)).alias(f"h{k}")
    return rows.select(*_CONVERSATION, (F.col("before") + F.col("i") + 1).alias("place"), "n_turns", running(1), running(2))


def maximal(hashed: DataFrame) -> DataFrame:
    """c and nul of the conversations that are no proper prefix of another, equal ones once."""
    ends = hashed.where("place = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min(F.struct("nul", "c")).alias("k"))
    inner = hashed.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return ends.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("k.c", "k.nul")


def render(keyed: DataFrame, blocks: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Per block of ``blocks``: conv_id, part (from 0), n_turns (of the whole conversation), chat. Parts in order make the chat."""
    safe = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    piece = F.concat(F.lit(start), safe("role"), F.lit("\n"), safe("text"), F.lit(end + "\n"))
    rows = keyed.select(*_KEYS, F.struct("turn", "digest", piece.alias("piece")).alias("t")).join(blocks.select(*_KEYS, "part", "n_turns"), _KEYS)
    parts = rows.groupBy(*_KEYS).agg(F.max("part").alias("part"), F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_set("t")).alias("p"))
    chat = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return parts.select(F.when(~F.col("nul"), F.col("c")).alias("conv_id"), "part", "n_turns", chat.alias("chat"))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered."""
    keyed = _keyed(turns)
    blocks, _ = common.stored(_blocks(keyed), "chat-places")
    hashed, path = common.stored(prefixes(blocks), "chat-prefixes")
    kept, _ = common.stored(blocks.drop("turns").join(maximal(hashed), _CONVERSATION, "left_semi"), "chat-kept")
    common.remove(turns.sparkSession, path)
    return render(keyed, kept)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(common.table(spark, sf_dir, "conversations"))


_SAFE = "replace(COALESCE({0}, ''), '<|im_', '< |im_')"
SQL = f"""
WITH a AS (
  SELECT conv_id, turn, role, text, COALESCE(CAST(floor(turn / {BLOCK}) AS BIGINT), CAST('{_LEAST}' AS BIGINT)) AS tb,
         sha256(COALESCE(length(role) || ':' || role, '-') || COALESCE(length(text) || ':' || text, '-')) AS digest
  FROM conversations
), l AS (
  SELECT conv_id, tb, sum(n) AS n, CAST(max(n) AS BIGINT) AS most FROM (SELECT conv_id, tb, turn, count(*) AS n FROM a GROUP BY ALL) GROUP BY ALL HAVING sum(n) > {2 * BLOCK}
), t AS (
  SELECT DISTINCT a.conv_id, turn, role, text, digest, a.tb, CASE WHEN most IS NULL THEN 0 ELSE COALESCE(turn, CAST('{_LEAST}' AS BIGINT)) END AS t2,
         CASE WHEN most > {2 * BLOCK} THEN substr(digest, 1, length(hex((most - 1) // {2 * BLOCK}))) ELSE '' END AS pre
  FROM a LEFT JOIN l ON a.conv_id IS NOT DISTINCT FROM l.conv_id AND a.tb = l.tb
), c AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, digest) AS turns FROM t GROUP BY conv_id
), u AS MATERIALIZED (SELECT turns, min(conv_id) AS conv_id, CAST(len(turns) AS BIGINT) AS n_turns FROM c GROUP BY turns
), p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM u)
), m AS (SELECT u.* FROM u ANTI JOIN p USING (turns)
), r AS (
  SELECT t.conv_id, tb, t2, pre, m.n_turns,
         string_agg('{START}' || {_SAFE.format('role')} || chr(10) || {_SAFE.format('text')} || '{END}' || chr(10), '' ORDER BY turn NULLS FIRST, digest) AS chat
  FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY 1, 2, 3, 4, 5
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY tb, t2, pre) - 1 AS part, n_turns, chat FROM r
"""

QUERIES = {"op3_chat_format": op3_chat_format}
ORACLE = {"op3_chat_format": SQL}
