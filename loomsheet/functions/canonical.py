"""The canonical function vocabulary, rewritten into Spark SQL expressions.

Users write one vocabulary whatever executes it: log is base 10, atan2 takes x
first, position takes the haystack first, a division by zero is null. Text is
tokenised (so strings, quoted names and comments of words stay untouched),
parsed into nested calls and groups, and written again with each call mapped
by name. Names that aren't known pass through as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

Resolve = Callable[[list[str]], str | None]

_TOKEN = re.compile(
    r"""\s+|'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|@?\[[^\]]*\](?:\.\[[^\]]*\])?|@\w+(?:\.\w+)?"""
    r"""|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_\u0080-￿][\w$]*|<=>|<>|<=|>=|!=|\|\||::|->|=>|.""",
    re.S,
)


@dataclass
class Call:
    name: str
    args: list[list]


@dataclass
class Group:
    body: list


def tokens(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text) if not t.isspace()]


_WORD = re.compile(r"[A-Za-z_\u0080-￿][\w$]*\Z")
#: Words before a parenthesis that call nothing.
_KEYWORDS = frozenset("and or not in between like case when then else end is over as from where exists select distinct on using filter within by any all union values interval escape rows range partition order group".split())


def parse(ts: list[str]) -> list:
    """Nested nodes: strings, Call and Group."""
    out, pos = _parse(ts, 0)
    if pos < len(ts):
        raise ValueError(f"unbalanced parenthesis near {' '.join(ts[max(0, pos - 3):pos + 1])!r}")
    return out


def _parse(ts: list[str], pos: int) -> tuple[list, int]:
    out: list = []
    while pos < len(ts):
        t = ts[pos]
        if t == ")":
            return out, pos
        if t == "(":
            if out and isinstance(out[-1], str) and _WORD.match(out[-1]) and out[-1].lower() not in _KEYWORDS:
                name, args, depth_args = out.pop(), [], []
                pos += 1
                while True:
                    depth_args, pos = _argument(ts, pos)
                    if depth_args or args:
                        args.append(depth_args)
                    if pos >= len(ts):
                        raise ValueError(f"{name}( isn't closed")
                    if ts[pos] == ")":
                        break
                    if not depth_args and not args:
                        args.append([])
                    pos += 1
                out.append(Call(name, args))
            else:
                body, pos = _parse(ts, pos + 1)
                if pos >= len(ts):
                    raise ValueError("a parenthesis isn't closed")
                out.append(Group(body))
        else:
            out.append(t)
        pos += 1
    return out, pos


def _argument(ts: list[str], pos: int) -> tuple[list, int]:
    """Nodes up to a comma or the closing parenthesis of this level."""
    depth, start = 0, pos
    while pos < len(ts):
        if ts[pos] == "(":
            depth += 1
        elif ts[pos] == ")":
            if not depth:
                break
            depth -= 1
        elif ts[pos] == "," and not depth:
            break
        pos += 1
    return _parse(ts[start:pos], 0)[0], pos


UNITS = {
    alias: unit
    for unit, names in {
        "YEAR": "year yy yyyy years", "QUARTER": "quarter qq q quarters", "MONTH": "month mm m months", "DAYOFYEAR": "dayofyear dy y", "DAY": "day dd d days",
        "WEEK": "week wk ww weeks", "HOUR": "hour hh hours", "MINUTE": "minute mi n minutes", "SECOND": "second ss s seconds", "MILLISECOND": "millisecond ms", "MICROSECOND": "microsecond mcs", "NANOSECOND": "nanosecond ns",
    }.items()
    for alias in names.split()
}


def unit_of(text: str | None) -> str:
    """The unit an alias stands for; DAY if there is none or it is unknown."""
    return UNITS.get((text or "").strip("'\" ").lower(), "DAY")


_FORMAT = [("yyyy", "yyyy"), ("month", "MMMM"), ("mon", "MMM"), ("mm", "MM"), ("dd", "dd"), ("hh24", "HH"), ("hh12", "hh"), ("hh", "HH"), ("mi", "mm"), ("ss", "ss"), ("ff3", "SSS"), ("am", "a"), ("pm", "a")]


def spark_format(pattern: str) -> str:
    """A date format of the canonical tokens as Spark's pattern."""
    out, rest = [], pattern
    while rest:
        for token, made in _FORMAT:
            if rest.lower().startswith(token):
                out.append(made)
                rest = rest[len(token) :]
                break
        else:
            out.append(f"'{rest[0]}'" if rest[0].isalpha() else rest[0])
            rest = rest[1:]
    return "".join(out)


_DAYS = [
    (r"\d{8}", "yyyyMMdd"), (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"), (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"), (r"\d{1,2} [A-Za-z]{4,} \d{4}", "d MMMM yyyy"),
]
_TIMES = [("", ""), (r" \d{1,2}:\d{2}", " H:mm"), (r" \d{1,2}:\d{2}:\d{2}", " H:mm:ss"), (r" \d{1,2}:\d{2}:\d{2}\.\d{1,6}", " H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]")]


def infer_format(literal: str) -> str | None:
    """Spark's pattern for a date or timestamp literal."""
    for day, day_format in _DAYS:
        for time, time_format in _TIMES:
            if re.fullmatch(day + time, literal):
                return day_format + time_format
    return None


_RENAMED = {"log": "log10", "left_trim": "ltrim", "right_trim": "rtrim", "substr": "substring"}
_LITERAL = re.compile(r"'.*'\Z|\d.*\Z|\.\d+\Z", re.S)


class Writer:
    """Writes nodes as Spark SQL. ``as_of``: the day that the functions of the current date see, as yyyy-MM-dd, with a time if need be."""

    def __init__(self, resolve: Resolve | None = None, as_of: str | None = None, guard: bool = True) -> None:
        self.resolve = resolve or (lambda parts: None)
        self.as_of, self.guard = as_of, guard

    @property
    def today(self) -> str:
        return f"DATE'{self.as_of[:10]}'" if self.as_of else "current_date()"

    @property
    def now(self) -> str:
        return f"TIMESTAMP'{self.as_of}'" if self.as_of else "current_timestamp()"

    def write(self, nodes: list) -> str:
        out: list[str] = []
        k = 0
        while k < len(nodes):
            node = nodes[k]
            if node in ("/", "%") and self.guard and k + 1 < len(nodes):
                divisor, k = self._primary(nodes, k + 1)
                out += [node, divisor if self._safe(divisor) else f"nullif({divisor}, 0)"]
                continue
            if node == "=" and k + 1 < len(nodes) and isinstance(nodes[k + 1], Call) and nodes[k + 1].name.lower() == "last":
                n, unit = self._last(nodes[k + 1])
                left = out.pop()
                out.append(self.between_last(left, n, unit))
                k += 2
                continue
            made, k = self._primary(nodes, k)
            out.append(made)
        return " ".join(x for x in out if x)

    def between_last(self, left: str, n: str, unit: str) -> str:
        return f"({left} BETWEEN {self.today} - INTERVAL {n} {unit} AND {self.today})"

    def _primary(self, nodes: list, k: int) -> tuple[str, int]:
        """One operand or sign, and where the next begins. A dotted name is one operand, and so is what its subscript picks."""
        node = nodes[k]
        follows = nodes[k + 1] if k + 1 < len(nodes) and isinstance(nodes[k + 1], str) and nodes[k + 1][0] == "[" else None
        if follows and isinstance(node, str) and node.lower() == "array":
            made, k = f"array({self.write(parse(tokens(follows[1:-1])))})", k + 2
        else:
            made, k = self._operand(nodes, k)
        if k + 1 < len(nodes) and isinstance(nodes[k], str) and nodes[k].lower() == "over" and isinstance(nodes[k + 1], Group):
            return f"{made} OVER ({self.write(nodes[k + 1].body)})", k + 2
        value = made[-1:] in ("`", ")") or bool(_WORD.match(made)) and made.lower() not in _KEYWORDS
        while value and k < len(nodes) and isinstance(nodes[k], str) and nodes[k][0] == "[":
            made, k = f"get({made}, ({self.write(parse(tokens(nodes[k][1:-1])))}) - 1)", k + 1
        return made, k

    def _operand(self, nodes: list, k: int) -> tuple[str, int]:
        node = nodes[k]
        if isinstance(node, Group):
            return f"({self.write(node.body)})", k + 1
        if isinstance(node, Call):
            return self.call(node), k + 1
        if node == "-" and k + 1 < len(nodes) and (k == 0 or isinstance(nodes[k - 1], str) and nodes[k - 1] in "+-*/(,=<>"):
            made, k = self._primary(nodes, k + 1)
            return f"- {made}" if made[0] == "-" else f"-{made}", k  # two signs side by side would begin a comment
        if _WORD.match(node) or node[0] in '"`':
            parts = [_bare(node)]
            while k + 2 < len(nodes) and nodes[k + 1] == "." and isinstance(nodes[k + 2], str):
                parts.append(_bare(nodes[k + 2]))
                k += 2
            if len(parts) == 1 and (now := self._clock(node.lower())):
                return now, k + 1
            found = self.resolve(parts)
            if found is None and len(parts) == 1:
                found = f"`{parts[0]}`" if node[0] == '"' else node
            return found or ".".join(f"`{p}`" for p in parts), k + 1
        if node[0] in "@[" and len(node) > 1:
            return self.resolve([node]) or node, k + 1
        return node, k + 1

    def _clock(self, name: str) -> str | None:
        """What stands for the current date, time (as text) or timestamp."""
        if name == "current_time":
            return f"date_format({self.now}, 'HH:mm:ss')"
        return {"current_date": self.today, "current_timestamp": self.now}.get(name)

    @staticmethod
    def _safe(divisor: str) -> bool:
        return bool(_LITERAL.match(divisor)) and not re.fullmatch(r"[0.]+([eE][+-]?\d+)?", divisor) or divisor.lower().startswith(("nullif(", "nullifzero("))

    def _last(self, call: Call) -> tuple[str, str]:
        args = [self.write(a) for a in call.args]
        return args[0], unit_of(args[1] if len(args) > 1 else None)

    def call(self, node: Call) -> str:
        name = node.name.lower()
        if name == "pass":
            return self._raw(node)
        special = getattr(self, f"_fn_{name}", None)
        args = [self.write(a) for a in node.args]
        if special and (made := special(*args)) is not None:
            return made
        if name == "count" and not args:
            return "count(*)"
        if node.args and node.args[0][:1] and isinstance(node.args[0][0], str) and node.args[0][0].lower() == "distinct":
            args[0] = "DISTINCT " + self.write(node.args[0][1:])
        return f"{_RENAMED.get(name, node.name)}({', '.join(args)})"

    def _raw(self, node: Call) -> str:
        """PASS(text): the text as it is, without the rewrites; references in it are still resolved."""
        text = node.args[0][0] if len(node.args) == 1 and len(node.args[0]) == 1 and isinstance(node.args[0][0], str) else None
        if text is None or text[0] != "'":
            raise ValueError("PASS takes one string")
        raw = text[1:-1].replace("''", "'")
        return Writer(self.resolve, self.as_of, guard=False).plain(parse(tokens(raw)))

    def plain(self, nodes: list) -> str:
        """The nodes with names resolved and nothing else changed."""
        out = []
        k = 0
        while k < len(nodes):
            node = nodes[k]
            if isinstance(node, Call):
                made, k = f"{node.name}({', '.join(self.plain(a) for a in node.args)})", k + 1
            elif isinstance(node, Group):
                made, k = f"({self.plain(node.body)})", k + 1
            else:
                made, k = self._primary(nodes, k)
            out.append(made)
        return " ".join(out)

    # Functions whose arguments change.
    def _fn_atan2(self, x, y):
        return f"atan2({y}, {x})"

    def _fn_log(self, *args):
        """Base 10, or of two arguments the first is the base."""
        return f"log({args[0]}, {args[1]})" if len(args) == 2 else None

    def _fn_position(self, haystack, needle=None):
        return None if needle is None else f"instr({haystack}, {needle})"

    def _fn_datediff(self, start, end, unit=None):
        u = unit_of(unit)
        return f"datediff({end}, {start})" if u == "DAY" else f"timestampdiff({u}, {start}, {end})"

    def _shift(self, d, n, unit, sign):
        u = unit_of(unit)
        if u == "DAYOFYEAR":
            u = "DAY"
        n = n if sign > 0 else f"-({n})"
        if u == "DAY":
            return f"({d} + CAST({n} AS INTERVAL DAY))"
        if u in ("YEAR", "QUARTER", "MONTH"):
            return f"({d} + CAST({ {'YEAR': 12, 'QUARTER': 3, 'MONTH': 1}[u]} * ({n}) AS INTERVAL MONTH))"
        if u == "WEEK":
            return f"({d} + CAST(7 * ({n}) AS INTERVAL DAY))"
        if u == "NANOSECOND":
            return f"timestampadd(MICROSECOND, CAST(({n}) / 1000 AS INT), {d})"
        return f"timestampadd({u}, {n}, {d})"

    def _fn_dateadd(self, d, n, unit=None):
        return self._shift(d, n, unit, 1)

    def _fn_datesub(self, d, n, unit=None):
        return self._shift(d, n, unit, -1)

    def _fn_d(self, literal, pattern=None):
        form = spark_format(pattern.strip("'")) if pattern else infer_format(literal.strip("'"))
        if form is None:
            raise ValueError(f"no date format fits {literal}")
        return f"to_timestamp({literal}, '{form}')" if re.search(r"[HhS]", form) else f"to_date({literal}, '{form}')"

    def _fn_tier(self, x, *bounds):
        label = lambda b: b.strip("'")
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        if not bounds:
            raise ValueError("tier takes a value and at least one bound")
        if len(bounds) == 1:
            return f"CASE WHEN {x} = {bounds[0]} THEN {quoted('equal ' + label(bounds[0]))} ELSE 'Unknown' END"
        cases = [f"WHEN {x} < {bounds[0]} THEN {quoted('< ' + label(bounds[0]))}"]
        cases += [f"WHEN {x} >= {a} AND {x} < {b} THEN {quoted(label(a) + '-' + label(b))}" for a, b in zip(bounds, bounds[1:])]
        cases.append(f"WHEN {x} >= {bounds[-1]} THEN {quoted('>= ' + label(bounds[-1]))}")
        return f"CASE {' '.join(cases)} ELSE 'Unknown' END"

    def _fn_if(self, condition, yes, no="NULL"):
        return f"if({condition}, {yes}, {no})"

    def _fn_current_date(self):
        return self.today

    def _fn_current_time(self):
        return self._clock("current_time")

    def _fn_current_timestamp(self):
        return self.now

    def _fn_element(self, array, index):
        return f"element_at({array}, {index})"


def _bare(name: str) -> str:
    return name[1:-1].replace(name[0] * 2, name[0]) if name[0] in '"`' else name


def rewrite(text: str, resolve: Resolve | None = None, as_of: str | None = None) -> str:
    """Canonical text as a Spark SQL expression."""
    return Writer(resolve, as_of).write(parse(tokens(text)))


#: Functions that aggregate; anything else is a scalar or a window function.
AGGREGATES = frozenset("sum count avg min max stddev stddev_pop stddev_samp variance var_pop var_samp median count_distinct approx_count_distinct first last_value first_value collect_set collect_list corr covar_pop covar_samp any_value percentile percentile_approx bool_and bool_or mode".split())


def calls(text: str) -> list[str]:
    """Names of all functions called in a text, outermost first."""
    found: list[str] = []

    def walk(nodes: list) -> None:
        for n in nodes:
            if isinstance(n, Call):
                found.append(n.name.lower())
                for a in n.args:
                    walk(a)
            elif isinstance(n, Group):
                walk(n.body)

    walk(parse(tokens(text)))
    return found


def is_window(text: str) -> bool:
    return any(t.lower() == "over" for t in tokens(text))


def is_aggregate(text: str) -> bool:
    return any(c in AGGREGATES for c in calls(text))


_REFERENCE = re.compile(r"@?\[([^\]]*)\](?:\.\[([^\]]*)\])?\Z|@(\w+)(?:\.(\w+))?\Z")


def reference(token: str) -> tuple[str | None, str] | None:
    """(block, item) of @[block].[item], @block.item, [item] or @item; block is None where it is left out or 'this'."""
    m = _REFERENCE.match(token)
    if not m:
        return None
    first, second = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
    if second is None:
        return None, first
    return (None if first.lower() == "this" else first), second


def references(text: str) -> list[tuple[str | None, str]]:
    return [r for t in tokens(text) if t[0] in "@[" and len(t) > 1 and (r := reference(t))]
