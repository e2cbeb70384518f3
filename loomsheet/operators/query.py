"""What a user asks for: queries, filters, blocks and reports, as frozen dataclasses."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Derived:
    """An item computed from others, which its formula names as [Item]: a scalar, an aggregate of an aggregate's result, or a window function."""

    name: str
    formula: str


@dataclass(frozen=True)
class Constant:
    name: str
    value: object


@dataclass(frozen=True)
class All:
    nodes: tuple

    def __init__(self, *nodes) -> None:
        object.__setattr__(self, "nodes", nodes)


@dataclass(frozen=True)
class Any:
    nodes: tuple

    def __init__(self, *nodes) -> None:
        object.__setattr__(self, "nodes", nodes)


@dataclass(frozen=True)
class Not:
    node: object


@dataclass(frozen=True)
class SetFilter:
    """Keep (or with ``exclude`` drop) rows whose values of the dimensions ``on`` occur in a block."""

    block: str
    on: tuple[str, ...]
    exclude: bool = False


@dataclass(frozen=True)
class Query:
    """``select`` holds names of dimensions and measures, Derived and Constant items, in the order wanted.

    ``where`` is a condition over [Field] names, or All, Any and Not of conditions.
    ``order``: (item, "asc" or "desc", optionally "nulls first" or "nulls last").
    ``grain``: safe, strict or reference, and ``disjoint``: suppress, cross or
    error, as the planner's ``plan`` describes them.
    """

    select: tuple
    where: object = None
    order: tuple = ()
    limit: int | None = None
    hints: tuple[str, ...] = ()
    disjoint: str = "suppress"
    grain: str = "safe"
    distinct: bool = False
    as_of: str | None = None
    sets: tuple[SetFilter, ...] = ()


@dataclass(frozen=True)
class BlockJoin:
    """``how``: inner, left, right, full, cross, left_semi or left_anti.

    ``on``: items that both blocks have, or pairs of an item of the source (or
    of a block joined before) and one of this block. It may also be text, pairs
    of ``@[block].[item] = @[block].[item]`` joined by ``and``. By default the
    items that both have as dimensions. Null meets null.
    """

    block: str
    how: str = "full"
    on: tuple[str | tuple[str, str], ...] | str | None = None


@dataclass(frozen=True)
class Block:
    """A named step of a report.

    Either a ``query``, or free ``sql`` over earlier blocks, or ``values`` (rows,
    with ``columns`` naming them), or a selection from the earlier block
    ``source`` and those joined to it, where ``*`` and ``@[block].*`` stand for
    all items. ``dims`` says which columns of SQL or values are dimensions; else
    it is those that are dimensions of an earlier block, and texts and dates.

    Where a selection leaves out dimensions, measures are aggregated again: by
    ``again`` (item to sum, max, min, count or avg) over all joined rows. Without
    it, each value of a block counts once, however often the join repeats it:
    sums and counts are added, of least and greatest values the least and
    greatest is taken; other measures, as averages, can't be aggregated again.
    """

    name: str
    query: Query | None = None
    sql: str | None = None
    source: str | None = None
    values: tuple[tuple, ...] | None = None
    columns: tuple[str, ...] = ()
    dims: tuple[str, ...] | None = None
    joins: tuple[BlockJoin, ...] = ()
    select: tuple = ()
    where: object = None
    order: tuple = ()
    limit: int | None = None
    again: dict[str, str] = field(default_factory=dict, hash=False)
    keep: bool = False  # materialise, because several blocks read it


@dataclass(frozen=True)
class Report:
    blocks: tuple[Block, ...]


def slug(name: str) -> str:
    """A column name: ASCII, lower case, words joined by underscores."""
    text = unicodedata.normalize("NFKD", name.replace("#", " n ").replace("%", " pct ")).encode("ascii", "ignore").decode()
    return re.sub(r"\W+", "_", text.lower()).strip("_") or "item"


def slugs(names: list[str], longest: int = 128) -> dict[str, str]:
    """Distinct column names for items, cut to ``longest`` characters; a number replaces the end of one that is taken."""
    out: dict[str, str] = {}
    for n in names:
        made = slug(n)[:longest]
        k = 1
        while made in out.values():
            k += 1
            made = slug(n)[: longest - len(str(k))] + str(k)
        out[n] = made
    return out
