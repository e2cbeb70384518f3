"""Secret scans: three base patterns, and a conditional random field that adds what they miss.

The base kinds are exact. The field tags whitespace tokens as secret begin,
inside or outside, from the token's shape, how rare its letter pairs are among
the sampled texts, the words beside it and features of the file. It is trained
here, on a bounded sample of texts whose base matches serve as labels. As these
know few shapes, each sampled text also gives snippets into which either an
invented secret of another shape is put, labelled so, or a harmless token that
looks odd: an address, a time, an identifier, a path. Of tagged spans, what
lies outside the base spans is added with the kind ``crf``.

Null is the empty text: no spans. Rows that repeat are scanned row by row.
Where no text can be sampled, the field adds nothing. Other columns are never
read. A table without rows gives none.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common, crf, vector

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is found from its start, as [0-9a-f]+ would
KINDS = ("assign", "access", "hex", "crf")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

Span = tuple[int, int, int]  # start, end, number of the kind


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """The base spans by start, then kind. ``raw``: the text in UTF-8, if at hand."""
    raw = text.encode() if raw is None else raw
    found: list[Span] = []
    lower = raw.lower()
    if any(k in lower for k in _KEYS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def shown(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


@dataclass(frozen=True)
class Settings:
    """``sample``: texts that the field learns from; ``windows``: stretches of ``length`` tokens taken from each; ``snippets``: stretches made from all of them together, about; ``sequences``: stretches in all, a third of them with a secret if there are so many."""

    sample: int = 3000
    windows: int = 12
    snippets: int = 9000
    length: int = 24
    sequences: int = 6000
    steps: int = 160


@dataclass(frozen=True)
class Model:
    """The field, and the surprise of each pair of letters."""

    field: crf.Model
    pairs: np.ndarray


# Features. Counts of kinds of bytes in a token come three to a 64-bit sum.
_KINDS = [b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdef", b"ghijklmnopqrstuvwxyz", bytes(range(128, 256)), b"\"'`", b"=", b"_-", b"/+", b"@", b".", b",;!?()[]{}<>#*$%&|~^\\", b":"]
_COUNTERS = np.zeros((5, 256), np.uint64)
for _k, _bytes in enumerate(_KINDS):
    _COUNTERS[_k // 3, list(_bytes)] = np.uint64(1) << np.uint64(21 * (_k % 3))
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(range(48, 58))] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
#: Letters as 0 to 25 without their case, the rest as 26.
_LETTER = np.full(256, 26, np.int32)
_LETTER[list(range(65, 91))] = _LETTER[list(range(97, 123))] = np.arange(26)
_IN_URL = re.compile(rb"hook|secret|passw|[?&;](?:sig|key|auth|code|api_?key|access)[a-z_]*=", re.I)
_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "auth", "bearer", "credential", "credentials", "access", "private", "passphrase", "passcode", "login", "creds")


def _hashes(words: Iterable[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(vector.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_KEYWORDS = _hashes(f"{q}{w}{q}{e}" for w in _WORDS for q in ("", '"', "'") for e in ("", ":", "="))
_SIGNS = _hashes(("=", ":", ":=", "=>", "is", "was", "to", "ist", "es", "est"))


#: Everyday words, whose letter pairs count beside those of the sampled texts.
_EVERYDAY = (
    "the user name session value number string object index table column content server client message address system version function method class public private static return "
    "long variable total compute result update delete create insert select input output file folder path image video music people world house river water mother father brother sister "
    "because through between against another different important information international government development university education company business service product customer "
    "account order payment report document history science research technology language question answer problem example chapter section travel hotel restaurant kitchen garden "
    "morning evening yesterday tomorrow january february september october november december monday wednesday thursday saturday children beautiful wonderful possible "
    "recipe thanks secret incorrect required invalid missing expired changed throw back comprehensible internal external default standard library package module install react script type "
    "straße gesellschaft schifffahrt kapitän donau dampf zwischen möglich wirtschaft regierung entwicklung wissenschaft sprache geschichte arbeit freundschaft verantwortung "
    "aujourd bonjour merci beaucoup toujours quelque pourquoi maison travail jeunesse gouvernement développement connaissance recherche université "
    "gracias también siempre trabajo ciudad desarrollo gobierno conocimiento investigación universidad pequeño corazón mañana porque hombre mujer"
).split()


def letter_pairs(data: np.ndarray) -> np.ndarray:
    """How often each pair of letters stands side by side: 27 by 27, the last row and column for what is no letter."""
    if len(data) < 2:
        return np.zeros((27, 27), np.int64)
    at = _LETTER[data]
    return np.bincount(at[:-1] * 27 + at[1:], minlength=729).reshape(27, 27)


def surprise(counts: np.ndarray) -> np.ndarray:
    """For each pair of letters a 64-bit sum: one in the upper half, and in the lower 256 times its rarity and 8 added.

    The rarity is the bits by which a letter is less likely to follow the other
    than if letters were drawn evenly, in the sampled texts or in everyday
    words, whichever makes it likelier.
    """
    bits = []
    for c in (counts, letter_pairs(np.frombuffer(" ".join(_EVERYDAY).encode(), np.uint8))):
        c = c[:26, :26] + 0.3
        bits.append(-np.log2(c / c.sum(axis=1, keepdims=True)) - np.log2(26))
    out = np.zeros((27, 27), np.uint64)
    out[:26, :26] = np.round(256 * np.clip(np.minimum(*bits) + 8, 0, 24)).astype(np.uint64) + (np.uint64(1) << np.uint64(32))
    return out.ravel()


def _member(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Token by feature, of 0 and 1. ``pairs``: what ``surprise`` returns."""
    n = len(starts)
    if not n:
        return np.zeros((0, WIDTH), np.uint8)
    mask21 = np.uint64((1 << 21) - 1)
    counts = []
    for table in _COUNTERS:
        sums = np.add.reduceat(table[data], starts)
        counts += [((sums >> np.uint64(21 * k)) & mask21).astype(np.int32) for k in range(3)]
    digit, upper, af, gz, other, quote, sign, dash, slash, at, dot, punct, colon = counts[:13]
    kind = _CLASS[data]
    turns = np.zeros(len(data), np.int32)
    turns[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    rises = np.zeros(len(data), np.int32)  # a capital after a small letter
    rises[1:] = (data[1:] >= 65) & (data[1:] <= 90) & (data[:-1] >= 97) & (data[:-1] <= 122)
    both = np.add.reduceat(turns + (rises << 16), starts)
    turns, rises = both & 0xFFFF, both >> 16
    letter = _LETTER[data]
    at_pair = np.full(len(data), 728, np.int32)
    at_pair[1:] = letter[:-1] * 27 + letter[1:]
    sums = np.add.reduceat(pairs[at_pair], starts)
    n_pairs = (sums >> np.uint64(32)).astype(np.int32)
    rare = (sums & np.uint64(0xFFFFFFFF)).astype(np.float64) / 256 / np.maximum(n_pairs, 1) - 8
    size = (ends - starts).astype(np.int32)
    letters = upper + af + gz
    solid = digit + letters
    h = vector.word_hashes(data, starts, ends)
    keyword, is_sign = _member(h, _KEYWORDS), _member(h, _SIGNS)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def beside(x: np.ndarray, k: int) -> np.ndarray:
        """The value k tokens ahead in the same text, else 0."""
        out = np.zeros(n, bool)
        if k < 0:
            out[-k:] = x[:k] & (doc[-k:] == doc[:k])
        else:
            out[:-k] = x[k:] & (doc[k:] == doc[:-k])
        return out

    def per_doc(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[first[1:]] - total[first[:-1]])[doc]

    # Addresses: with "://", with a name and a password before "@", with words that promise a secret.
    url, telling = np.zeros(n, bool), np.zeros(n, bool)
    colons = np.flatnonzero(data[:-2] == 58)
    marks = colons[(data[colons + 1] == 47) & (data[colons + 2] == 47)]
    found = np.searchsorted(starts, marks, "right") - 1
    found = np.unique(found[marks < ends[found]])
    url[found] = True
    for k in found.tolist():
        telling[k] = _IN_URL.search(data[starts[k] : ends[k]].tobytes()) is not None
    login = url & (at > 0) & (colon >= 2)
    mail = (at > 0) & (dot > 0) & ~url
    time = (af + gz == 0) & (upper <= 2) & (digit >= 4) & (dash + colon + slash >= 2)
    groups = (gz + upper + punct == 0) & (colon >= 2)  # IPv6 and MAC addresses
    numbers = (letters == 0) & (digit > 0)
    same = np.zeros(len(data), np.int32)
    same[1:] = data[1:] == data[:-1]
    drawn_out = 2 * np.add.reduceat(same, starts) >= size
    plain = url & ~login & ~telling | mail | time | groups | numbers | drawn_out
    seen = (n_pairs >= 3) & ~plain
    rare1, rare2, rare3 = seen & (rare > -1), seen & (rare > -0.3), seen & (rare > 0.4)
    long_run = (solid >= 16) & (digit >= 2)
    odd = (digit > 0) | (punct > 1)
    mixed = (digit > 0) & (letters > 0) | (rises > 0) | rare3
    random = ~plain & (turns + rises >= 3) & (rare1 | (turns + rises >= 6))
    wild = ~plain & (size >= 6) & (mixed | (punct > 1) & (letters > 0))
    tokens = np.diff(first)[doc]
    big = size >= 16
    columns = [
        np.ones(n, bool),
        size < 4, (size >= 4) & (size < 8), (size >= 8) & (size < 12), (size >= 12) & (size < 16), (size >= 16) & (size < 24), (size >= 24) & (size < 40), size >= 40,
        digit > 0, (digit > 0) & (letters > 0), (digit >= 4) & (letters >= 4), numbers, numbers & (digit >= 12),
        (upper > 0) & (af + gz > 0) & (digit > 0), rises > 0, rises >= 3, (upper == letters) & (upper > 3),
        (gz + upper == 0) & (digit + af >= 16), (af + gz == 0) & (upper + digit >= 16) & (digit > 0), long_run, long_run & ~plain,
        turns >= 2, turns >= 4, turns >= 8,
        other > 0, quote > 0, quote > 1, sign > 0, colon > 0, dash > 0, slash > 0, slash > 2, at > 0, dot > 0, dot >= 3, punct > 0, punct > 2,
        solid == 0, keyword, is_sign,
        rare1, rare2, rare3, rare1 & big, rare2 & big, rare3 & big, rare2 & big & (size >= 24), rare2 & big & (digit > 0), seen & (rare < -1.5), seen & (rare < -2) & big,
        random, random & big, random & (size >= 24), random & big & (dash + dot > 0), wild,
        url, url & login, url & telling, url & telling & random, plain, mail, time, groups, drawn_out,
        beside(keyword, -1), beside(keyword, -2), beside(keyword, 1), beside(is_sign, -1), beside(is_sign, 1),
        beside(is_sign, -1) & beside(keyword, -2), (beside(keyword, -1) | beside(keyword, -2) & beside(is_sign, -1)) & wild, beside(keyword, -1) & random, beside(keyword, -2) & random,
        beside(quote > 1, 1), beside(long_run, 1), beside(long_run, 2), beside(long_run, -1),
        per_doc(keyword) > 0, 20 * per_doc(odd) > tokens, per_doc(long_run & ~plain) > 0,
    ]
    return np.stack(columns, axis=1).astype(np.uint8)


WIDTH = 80
_STRIP = "\"'`,;:=()[]{}<>!?#*$%&|"


def _tokens(texts: pa.Array):
    data, offsets = vector.buffers(texts)
    return (data, offsets, *vector.words(data, offsets))


_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UP + _LOW + _DIGITS


def _drawn(rng: random.Random, n: int, of: str = _ALNUM) -> str:
    return "".join(rng.choices(of, k=n))


def _password(r: random.Random) -> str:
    """Eight to sixteen characters of three kinds or more."""
    out = list(_drawn(r, r.randint(4, 12)) + r.choice(_UP) + r.choice(_LOW) + r.choice(_DIGITS) + r.choice("!#$%&*+-?@^_."))
    r.shuffle(out)
    return "".join(out) if out[0] not in "!#$%&*?" and r.random() < 0.7 else _drawn(r, r.randint(8, 14)) + r.choice(("", "!", "1", "#"))


# Makers of secrets and of harmless tokens. Each takes a source of chance and the words of a text.
_SECRETS = (
    lambda r, w: _drawn(r, r.randint(1, 5), r.choice((_LOW, _UP, _ALNUM))) + r.choice("_-.") + r.choice(("", "", "live_", "v1.", "proj-")) + _drawn(r, r.randint(18, 48)),
    lambda r, w: _drawn(r, r.randint(20, 60)),
    lambda r, w: _drawn(r, r.randint(24, 76), _ALNUM + "+/") + r.choice(("", "=", "==")),
    lambda r, w: _drawn(r, r.randint(22, 60), _ALNUM + "_-"),
    lambda r, w: _drawn(r, r.choice((24, 32, 40, 64)), r.choice(("0123456789ABCDEF", _LOW + _DIGITS, _UP + _DIGITS))),
    lambda r, w: _drawn(r, r.randint(24, 48), r.choice((_LOW, _UP))),
    lambda r, w: ".".join(_drawn(r, n, _ALNUM + "_-") for n in (r.randint(18, 40), r.randint(20, 60), r.randint(27, 48))),
    lambda r, w: "-".join(_drawn(r, r.randint(9, 13), _DIGITS) if k else _drawn(r, 4, _LOW) for k in range(r.randint(2, 3))) + "-" + _drawn(r, r.randint(20, 32)),
    lambda r, w: "-".join(_drawn(r, 5, _UP + _DIGITS) for _ in range(5)),
    lambda r, w: f"{r.choice(('mysql', 'redis', 'amqp', 'ftp', 'https', _drawn(r, 6, _LOW)))}://{r.choice(w)[:12]}:{_drawn(r, r.randint(8, 20))}@{r.choice(w)[:12]}.{r.choice(('local', 'net', 'internal'))}{r.choice(('', ':5432', '/db', ':6379/0'))}",
    lambda r, w: f"https://{r.choice(('hooks', 'webhook'))}.{_drawn(r, 6, _LOW)}.com/{r.choice(w)[:9]}/{_drawn(r, 9, _UP + _DIGITS)}/{_drawn(r, r.randint(18, 30))}",
)
_LED = (lambda r, w: _password(r), lambda r, w: _password(r))
_LEADS = ("key", "api key", "token:", "token", "Bearer", "Authorization: Bearer", "password is", "password:", "Password is", "passwd =", "password was", "secret= ", "access key =", "login with password", "the passphrase is", "pwd:", "credentials:")


def _camel(r: random.Random, w: list[str]) -> str:
    parts = [x[:10] for x in r.choices(w, k=r.randint(2, 5))]
    return parts[0].lower() + "".join(x.capitalize() for x in parts[1:])


_HARMLESS = (
    lambda r, w: f"{_drawn(r, 5, 'abcdeilnorst')}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
    lambda r, w: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}",
    lambda r, w: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    lambda r, w: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(10, 28)}" + r.choice(("", f"T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}" + r.choice(("", "Z", "+02:00", ".123Z")))),
    lambda r, w: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}" + r.choice(("", f"-beta{r.randint(1, 9)}", "-rc.1", "+build.77")),
    lambda r, w: f"https://{r.choice(w)[:12]}.{r.choice(('com', 'org', 'net'))}/{'/'.join(x[:10] for x in r.choices(w, k=r.randint(1, 4)))}{r.choice(('', '.html', '/', f'?id={r.randint(1, 99999)}', f'?page={r.randint(1, 9)}&ref=x'))}",
    lambda r, w: f"https://{r.choice(('www.', ''))}{r.choice(w)[:12]}.{r.choice(('com', 'org', 'io'))}/{r.choice(('watch?v=', 'p/', 'd/', 'item/', 'f/'))}{_drawn(r, r.randint(8, 24))}{r.choice(('', f'?id={r.randint(1, 9999)}', '&t=4s', '/edit'))}",
    lambda r, w: f"{r.randint(1, 99)},{r.randint(100, 999)}.{r.randint(10, 99)}",
    lambda r, w: ":".join(_drawn(r, r.randint(1, 4), "0123456789abcdef") for _ in range(r.choice((6, 8)))).replace(":0:", "::", 1),
    lambda r, w: _camel(r, w) + r.choice(("", str(r.randint(1, 99)), f"V{r.randint(1, 9)}", "()", f"({_camel(r, w)}{r.randint(1, 9999)}", f"V{r.randint(2, 9)}By{r.choice(w)[:8].capitalize()}")),
    lambda r, w: f"{_camel(r, w)}({_camel(r, w)}{_drawn(r, r.randint(2, 10), _DIGITS)}{r.choice(('', ')', ');'))}",
    lambda r, w: "_".join(x[:10] for x in r.choices(w, k=r.randint(2, 5))) + r.choice(("", str(r.randint(1, 999)), "()", "=1")),
    lambda r, w: "-".join(x[:10] for x in r.choices(w, k=r.randint(2, 6))) + r.choice(("", f"-{r.randint(1, 2030)}")),
    lambda r, w: "/".join(["", *(x[:10] for x in r.choices(w, k=r.randint(2, 5)))]) + r.choice(("", ".so.6", ".py", f"_{r.randint(1, 99)}.txt", f"/{_drawn(r, 4, _DIGITS)}.log")),
    lambda r, w: "".join(x[:12] for x in r.choices(w, k=r.randint(2, 4))),
    lambda r, w: r.choice(("README.md", "ISO9001", "BY-NC-SA", "2.0.", "COVID19", "MacBookPro15,1", "item12345", "x86_64-linux-gnu", "--max-size=4096", "10.1000/xyz123", "H2SO4", "(2014)", "ISBN-13:", "utf-8", "1st", "3D", "A4", "e.g.", "&nbsp;", "C++17")),
    lambda r, w: _drawn(r, r.randint(10, 19), _DIGITS),
    lambda r, w: f"{r.choice(w)[:10]}={r.choice(w)[:10]}",
    lambda r, w: f'{r.choice(("class", "id", "name", "href"))}="{r.choice(w)[:10]}-{r.choice(w)[:10]}-{r.randint(1, 12)}"',
    lambda r, w: f"#{r.choice((r.choice(w)[:12], _camel(r, w), _camel(r, w).capitalize()))}{r.choice(('', r.randint(1, 99), r.randint(1990, 2030)))}",
    lambda r, w: f"{r.choice(w)[:6]}:{r.randint(1, 9999)}{r.choice(('.', '/', '-'))}{r.randint(1, 99999)}{r.choice(('', 'v2', 'a', '.pdf'))}",
    lambda r, w: r.choice("=-_*.~aA") * r.randint(8, 40),
    lambda r, w: _drawn(r, r.randint(6, 20), "abcdeilnorst"),
    lambda r, w: _drawn(r, r.randint(6, 20), "ABCDEILNORST") + r.choice(("!!", ".!!", ",!!", "")),
    lambda r, w: _drawn(r, r.randint(3, 9), "abcdeilnorst") + r.choice(("***", "###", "%%%", "$$$", "&&&")),
    lambda r, w: r.choice(("secret", "password", "token", "key", "access")),
    lambda r, w: r.choice(w).upper() + r.choice(("!!", "", ",", "?!")),
)


def snippet(words: list[str], names: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """Some of the words around a secret or a harmless token, which may use ``names``, and the tag of each token."""
    at = rng.randrange(len(words) + 1)
    before, after = words[max(0, at - rng.randint(0, 9)) : at], words[at : at + rng.randint(0, 9)]
    letters = [*(rng.choices(names, k=20) if names else ()), *rng.choices(_EVERYDAY, k=20)]
    hidden = rng.random() < 0.5
    led = hidden and rng.random() < 0.35
    lead = rng.choice(_LEADS).split() if led or rng.random() < 0.3 else []
    body = rng.choice(_LED if led else _SECRETS if hidden else _HARMLESS)(rng, letters)
    if not hidden and lead and rng.random() < 0.5:  # what follows a keyword is most often a word
        body = rng.choice(letters) + rng.choice(("", "!", ".", ","))
    body = [rng.choice(("{}", "{}", '"{}"', "{}.", "{},", "'{}'", "({})")).format(body)] if hidden else body.split()
    tokens = [*before, *lead, *body, *after]
    tags = [crf.OUTSIDE] * len(tokens)
    if hidden:
        tags[len(before) + len(lead)] = crf.BEGIN
    return " ".join(tokens), tags


def sampled(docs: DataFrame, n: int) -> DataFrame:
    """``n`` rows at most, those of the least hashes of id and text: the same in every run. ``docs``: doc_id, text."""
    total = docs.count()
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    few = docs if total <= n else docs.where(h < F.lit(min(1.0, (2 * n + 200) / total) * (1 << 62)))  # so that no more are sorted
    return few.orderBy(h, "doc_id", F.length("text"), "text").limit(n)


def sample_windows(chosen: DataFrame, s: Settings, pairs: np.ndarray, n: int) -> list:
    """Stretches of tokens with features, eight to a byte, and tags, from the ``n`` sampled texts; ``chosen``: doc_id, text."""
    each = -(-s.snippets // max(1, n))

    def run(batches):
        for batch in batches:
            data, offsets, starts, ends, first = _tokens(batch.column(1))
            x = np.packbits(f := features(data, starts, ends, first, pairs), axis=1)
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [d or 0 for d in batch.column(0).to_pylist()]
            for d, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                a, b = int(first[d]), int(first[d + 1])
                tags = np.zeros(b - a, np.uint8)
                raw = text.encode()
                for p, q, _ in base_spans(text, raw):
                    lo, hi = (len(text[:v].encode()) + int(offsets[d]) for v in (p, q))
                    hit = np.flatnonzero((starts[a:b] < hi) & (ends[a:b] > lo))
                    if len(hit) and not tags[hit].any():
                        tags[hit] = crf.INSIDE
                        tags[hit[0]] = crf.BEGIN
                odd = f[a:b, 8] | (tags > 0)
                rank = [(-int((tags[k : k + s.length] > 0).any()), -int(odd[k : k + s.length].any()), k) for k in range(0, b - a, s.length)]
                for _, _, k in sorted(rank)[: s.windows]:
                    out.append((doc_id, k, x[a + k : min(b, a + k + s.length)].tobytes(), tags[k : k + s.length].tobytes()))
            made = []
            for d, t in zip(ids, texts, strict=True):
                words = t.split()[:400]
                names = [x for x in words if x.isascii() and x.isalpha() and len(x) > 2]
                made += [(d, k, *snippet(words, names, random.Random(d * each + k))) for k in range(each)]
            data, _, starts, ends, first = _tokens(pa.array([t for _, _, t, _ in made], pa.string()))
            x = np.packbits(features(data, starts, ends, first, pairs), axis=1)
            for m, (d, k, _, tags) in enumerate(made):
                a, b = int(first[m]), int(first[m + 1])
                if b - a == len(tags):  # words of other white space are split otherwise; such a snippet is left out
                    for j in range(0, b - a, s.length):
                        out.append((d, -1 - 100 * k - j, x[a + j : min(b, a + j + s.length)].tobytes(), bytes(tags[j : j + s.length])))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["d", "k", "x", "t"])

    return common.in_batches(chosen, run, "d long, k int, x binary, t binary").collect()


def _pairs_of(chosen: DataFrame) -> np.ndarray:
    """``surprise`` of the letter pairs of the sampled texts."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([letter_pairs(vector.buffers(batch.column(1))[0]).astype(np.int64).tobytes()], pa.binary())], names=["c"])

    rows = common.in_batches(chosen, run, "c binary").collect()
    return surprise(sum((np.frombuffer(r.c, np.int64) for r in rows), np.zeros(729, np.int64)).reshape(27, 27))


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The field, or None if there is no text to sample. The driver gets ``windows`` stretches of each of ``sample`` texts, and those of ``snippets`` snippets and one a text more, at most; a snippet may make two."""
    chosen, path = common.stored(sampled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), settings.sample), "secrets-sample")
    pairs = _pairs_of(chosen)
    rows = sample_windows(chosen, settings, pairs, chosen.count())
    common.remove(docs.sparkSession, path)
    rows = sorted(rows, key=lambda r: (vector.mix(np.array([r.d * 1000003 + r.k], np.int64).view(np.uint64))[0], r.x))
    hits = [r for r in rows if any(r.t)][: settings.sequences // 3]
    rows = hits + [r for r in rows if not any(r.t)][: settings.sequences - len(hits)]
    if not hits:
        return None
    x = np.zeros((len(rows), settings.length, WIDTH), np.uint8)
    t = np.zeros((len(rows), settings.length), np.int64)
    mask = np.zeros((len(rows), settings.length), bool)
    for i, r in enumerate(rows):
        n = len(r.t)
        x[i, :n] = np.unpackbits(np.frombuffer(r.x, np.uint8).reshape(n, -1), axis=1, count=WIDTH)
        t[i, :n] = np.frombuffer(r.t, np.uint8)
        mask[i, :n] = True
    return Model(crf.train(x, t, mask, settings.steps), pairs)


#: Bytes of texts that a scan takes at a time; those of short words need a hundred times as much for their features.
SCAN_BYTES = 512 << 10


def scan(model: Model | None, texts: pa.Array) -> list[list[Span]]:
    """All spans of each text."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    return [spans for part in common.pieces(batch, common.BATCH_ROWS, SCAN_BYTES) for spans in _scan(model, part.column(0))]


def _scan(model: Model | None, texts: pa.Array) -> list[list[Span]]:
    values = texts.to_pylist()
    data, offsets, starts, ends, first = _tokens(texts)
    found = []
    tags = crf.tag(model.field, model.field.emissions(features(data, starts, ends, first, model.pairs)), first) if model is not None and len(starts) else np.zeros(len(starts), np.int8)
    busy = np.flatnonzero(tags)
    of = np.searchsorted(first, busy, "right") - 1
    by_doc: dict[int, list[int]] = {}
    for k, d in zip(busy.tolist(), of.tolist(), strict=True):
        by_doc.setdefault(d, []).append(k)
    hexed = _hex_docs(data, offsets)
    for d, text in enumerate(values):
        if not text:
            found.append([])
            continue
        raw = data[offsets[d] : offsets[d + 1]].tobytes()
        base = base_spans(text, raw) if hexed[d] or b"AKIA" in raw or any(k in raw.lower() for k in _KEYS) else []
        more: list[list[int]] = []
        added: list[Span] = []
        for k in by_doc.get(d, ()):
            if more and tags[k] == crf.INSIDE and more[-1][1] == k:
                more[-1][1] = k + 1
            else:
                more.append([k, k + 1])
        read, passed = 0, 0  # bytes, and the characters in them
        for p, q in more:
            lo, hi = int(starts[p] - offsets[d]), int(ends[q - 1] - offsets[d])
            passed += len(raw[read:lo].decode())
            read, piece = lo, raw[lo:hi].decode()
            a = passed + len(piece) - len(piece.lstrip(_STRIP))
            b = a + len(piece.strip(_STRIP))
            added += [(x, y, 3) for x, y in _beyond(text, a, b, base)]
        found.append(sorted(base + added, key=lambda s: (s[0], s[2])))
    return found


def _beyond(text: str, a: int, b: int, base: list[Span]) -> list[tuple[int, int]]:
    """What of a tagged span lies outside the base spans: the parts that are more than punctuation."""
    parts, at = [], a
    for x, y, _ in base:
        if x < b and y > at:
            parts.append((at, x))
            at = y
    if at == a:
        return [(a, b)] if b > a else []
    out = []
    for x, y in [*parts, (at, b)]:
        piece = text[x:y]
        x += len(piece) - len(piece.lstrip(_STRIP + "."))
        if rest := piece.strip(_STRIP + "."):
            out.append((x, x + len(rest)))
    return out


def _hex_docs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text may hold a run of 16 hexadecimal digits."""
    out = np.zeros(len(offsets) - 1, bool)
    hexed = np.zeros(len(data) + 2, bool)
    hexed[1:-1] = _HEX[data]
    edge = np.flatnonzero(hexed[1:] != hexed[:-1])
    runs = edge[::2][edge[1::2] - edge[::2] >= 16]
    ends = edge[1::2][edge[1::2] - edge[::2] >= 16]
    for at in (runs, ends - 1):  # a run may go on into the next texts; each of those is looked at as well
        out[np.clip(np.searchsorted(offsets, at, "right") - 1, 0, len(out) - 1)] = True
    for a, b in zip(runs.tolist(), ends.tolist(), strict=True):
        lo, hi = np.searchsorted(offsets, [a, b - 1], "right") - 1
        out[lo : hi + 1] = True
    return out


_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def scanned(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_crf, base_sha256 and spans (kind:start:end, in code points, joined by commas)."""

    def run(batches):
        for batch in batches:
            every = scan(model, batch.column(1))
            counts = [pa.array([sum(k == kind for _, _, k in s) for s in every], pa.int64()) for kind in range(4)]
            digests = [sha256(shown(x for x in s if x[2] < 3).encode()).hexdigest() for s in every]
            columns = [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(shown, every), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.in_batches(chosen, run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    out, end = [], 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = scanned(docs, fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE: dict[str, str] = {}
