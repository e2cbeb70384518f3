"""PII surrogates: keyed, type-consistent replacements that stay distinct.

E-mail addresses, telephone numbers, IPv4 and IPv6 addresses, IBANs, social
security and card numbers are replaced by a keyed permutation of all strings of
the same format: digits stay digits, letters keep their script and case,
separators stay, an octet stays an octet of as many digits, a group of several
digits keeps its leading zero or has none, a card's Luhn remainder stays, an
IBAN's check digits fit. The permutation is one cycle, so no value is replaced
by itself, two values never share a surrogate, and one value has the same
surrogate everywhere in a corpus of any size, without a table.

A person is a known given name, or what follows a title or words that announce
a name, with one or two capitalised words behind it. A known given name moves
along a keyed cycle through the names of its gender and script; the cycle
depends on the surname. Surnames, and given names that no list has, are permuted
letter by letter, vowels among vowels and consonants among consonants, and an
unknown given name keeps its last letter, which often tells the gender. If that
makes a listed name, it is permuted again until it is none: else it could meet
a surrogate of a listed name. So different names never share a surrogate, and
a family keeps one surname. Names are compared without regard to case. Later
mentions by given name or surname alone, in the same text, follow the full
name. ``collisions`` checks a corpus for surrogates that two values share.

Null texts stay null and hold nothing. Rows that repeat are replaced alike. An
entity inside another isn't replaced by itself; of two that begin together, the
kind that comes first in PATTERNS counts. Tables without rows give none. Columns
other than those in ``keep`` are never read.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import common

KINDS = ("email", "phone", "ipv4", "card", "person", "ipv6", "iban", "id")
DEMO_KEY = b"loomsheet: replace this key"

# Given names by script and gender; surrogates come from the same list.
GIVEN = {
    ("latin", "f"): (
        "Anna Maria Julia Laura Sophie Emma Clara Lucia Elena Marta Camille Chloe Amelie Juliette Manon Ingrid Heike Sabine Petra Carmen Pilar Olivia Emily Grace Alice Hannah Katharina Isabel Sarah Charlotte "
        "Mary Jane Linda Barbara Susan Jessica Karen Nancy Lisa Margaret Sandra Ashley Kimberly Donna Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Helen Ruth Diane Julie Joyce Victoria Kelly Christina Catherine Virginia Rachel Teresa Monika Ursula Renate Birgit Andrea Claudia Nicole Anja Katja Silke Marie Nathalie Isabelle Sylvie Martine Valérie Céline Aurélie Inès Léa Ana Rosa Dolores Cristina Beatriz Lucía Paula Sofia Giulia Chiara Francesca Priya Aisha Fatima Leila Yasmin Mei Yuki Sakura Olga Natasha Svetlana Irina Zofia Agnieszka Ewa"
    ).split(),
    ("latin", "m"): (
        "Peter Paul Martin Thomas David Daniel Lucas Hugo Louis Antoine Pierre Julien Carlos Javier Miguel Pablo Diego Hans Jürgen Stefan Klaus Wolfgang James William Henry Oliver George Robert Michael Andreas "
        "John Richard Joseph Charles Christopher Matthew Anthony Mark Donald Steven Andrew Kenneth Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Frank Alexander Raymond Patrick Jack Dennis Jerry Tyler Aaron José Adam Nathan Walter Werner Dieter Günther Heinz Uwe Jens Sven Lars Matthias Tobias Florian Felix Jean Jacques Philippe Nicolas Laurent François Michel Luis Juan Pedro Manuel Fernando Antonio Francisco Jorge Sergio Marco Luca Giovanni Mohammed Muhammad Ahmed Ali Omar Hassan Ibrahim Raj Arjun Amit Wei Hiroshi Kenji Ivan Dmitri Sergei Piotr Tomasz Jan"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Дарья Полина Ксения Вера Людмила Алиса".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Максим Егор Юрий Олег Борис Виктор".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Ειρήνη Δήμητρα Χριστίνα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Γιάννης Δημήτρης Παναγιώτης Μιχάλης Ανδρέας".split(),
}
_OF_NAME = {name: group for group, names in GIVEN.items() for name in names}
#: Letters by script and case. A letter keeps its class; others are classed by their block of Unicode and their kind.
_LETTERS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àâäáãåæçéèêëíîïñóôöõøúûüýß", "ÀÂÄÁÃÅÆÇÉÈÊËÍÎÏÑÓÔÖÕØÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_CLASS = {c: a for a in [*_LETTERS, _DIGITS] for c in a}
#: Small letters of names: vowels and consonants.
_SOUNDS = {c: a for a in ("aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåæéèêëíîïóôöõøúûüý", "çñß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ") for c in a}


@lru_cache(maxsize=4096)
def letter_class(c: str) -> str:
    """The letters or digits that may replace one; of anything else, itself."""
    if c in _CLASS:
        return _CLASS[c]
    kind, first = unicodedata.category(c), ord(c) // 128 * 128
    if kind[0] not in "LN":
        return c
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and x not in _CLASS)


_GAP = r"\W{1,6}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", re.A),
    "ipv6": re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![\w:])", re.A),
    "ipv4": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)", re.A),
    "phone": re.compile(rf"(?<![\w+])(?:\+\d{{1,3}}{_GAP}|\b00\d{{1,3}}{_GAP})?\(\d{{2,4}}\){_GAP}\d{{3,4}}\W{{1,3}}\d{{3,4}}(?!\w)|(?<![\w+])\+\d{{1,3}}[ .-]?\d{{2,4}}[ .-]\d{{3,4}}(?:[ .-]\d{{2,4}})?(?!\w)|(?<![\w+])\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?!\w)|(?<![\w+.,/-])0\d{{2,4}}[ /-]\d{{5,8}}(?![\w-])", re.A),
    "id": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A),
    "card": re.compile(r"(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w)", re.A),
}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ][\w'’]*(?:-[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ]\w+)*"
_PERSON = re.compile(rf"(?<!\w)(?<!\w-)({_CAPITAL})(?=((?: {_CAPITAL}){{1,2}})(?!\w))")
#: Titles, of which all but those of either gender tell it, and words that announce a name.
_CUES = re.compile(
    r"(?<!\w)(?:(?:(?P<title>Mrs|Mr|Ms|Miss|Sir|Lady|Dr|Prof|Herr|Herrn|Frau|Señora|Señor|Sra|Sr|Don|Doña|Monsieur|Madame|Mme|господин|госпожа|κύριος|κυρία)\.? )+"
    r"|(?:[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es|[Mm]on nom est|[Мм]еня зовут|(?:[Nn]ame|Nom|Nombre|Contact|Kontakt|Signed):) )"
    rf"(?P<name>{_CAPITAL}(?: {_CAPITAL}){{0,2}})(?!\w)"
)

Entity = tuple[int, int, str, str]  # start, end, kind, canonical form


def issued(digits: str) -> bool:
    """Whether a number has the first digits and the length of a card issuer's."""
    n, a, b = len(digits), int(digits[:2]), int(digits[:4])
    return n == 16 and (digits[0] == "4" or 51 <= a <= 55 or 2221 <= b <= 2720 or b == 6011 or a in (65, 35)) or n in (13, 19) and digits[0] == "4" or n == 15 and a in (34, 37) or n == 14 and a in (36, 38)


def _accepted(kind: str, found: str) -> str | None:
    """The canonical form of a match, or None if it is none of the kind."""
    if kind == "card":
        digits = re.sub(r"\D", "", found)
        # A run of digits must be an issuer's number and pass the Luhn test; one in a card's groups, either.
        right, ours = not _luhn(digits), issued(digits)
        return found if (right and ours if digits == found else right or ours) else None
    if kind == "iban":
        compact = found.replace(" ", "")
        return found if 15 <= len(compact) <= 34 and _remainder(compact) == 1 else None
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(found).compressed if found.count(":") >= 2 and re.search(r"[0-9A-Fa-f]", found) and len(found) > 4 else None
        except ValueError:
            return None
    return found


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _titled(name: str) -> str:
    return " ".join("-".join(p.capitalize() for p in part.split("-")) for part in name.split(" "))


def _known(given: str) -> bool:
    return _titled(given).split("-")[0] in _OF_NAME


def entities(text: str) -> list[Entity]:
    """Entities in order, without overlaps; where two overlap, the kind that comes first in PATTERNS stays, and of a kind the first."""
    found: list[Entity] = []
    used = bytearray(len(text))  # 1 where an entity is

    def put(a: int, b: int, kind: str, value: str) -> bool:
        if used.find(1, a, b) >= 0:
            return False
        used[a:b] = b"\1" * (b - a)
        found.append((a, b, kind, value))
        return True

    if any(map(text.__contains__, "@0123456789")):
        for kind, pattern in PATTERNS.items():
            if kind == "email" and "@" not in text or kind == "ipv6" and text.count(":") < 2:
                continue
            for m in pattern.finditer(text):
                if (value := _accepted(kind, m[0])) is not None:
                    put(m.start(), m.end(), kind, value)
    known: dict[str, str] = {}

    def person(a: int, b: int, name: str) -> None:
        if put(a, b, "person", name) and name[0] != " ":
            given, rest = name.split(" ", 1)
            for x in (given, rest, *rest.split(" ")):
                known.setdefault(x, name)

    for m in _PERSON.finditer(text):
        if _known(m[1]):
            person(m.start(), m.end(2), _titled(m[1] + m[2]))
    for m in _CUES.finditer(text):
        name = _titled(m["name"])
        alone = " " not in name  # after a title, one name is a surname
        if not alone or m["title"]:
            person(m.start("name"), m.end("name"), " " + name if alone else name)
    if known:
        either = sorted({y for x in known for y in (x, x.upper())}, key=len, reverse=True)
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, either)) + r")(?!\w)", text):
            put(m.start(), m.end(), "person", f"{known[_titled(m[0])]}\0{_titled(m[0])}")
    return sorted(found)


def _number(key: bytes, what: str) -> int:
    return int.from_bytes(hmac.digest(key, what.encode(), "sha256"), "big")


def _feistel(x: int, size: int, key: bytes, label: str, rounds: range) -> int:
    """A keyed permutation of 0 .. size - 1 (its inverse with ``rounds`` reversed): Feistel rounds, repeated until the value is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    back = rounds.step < 0
    while True:
        a, b = x >> half, x & mask
        for r in rounds:
            if back:
                a, b = b ^ (_number(key, f"{label}|{r}|{a}") & mask), a
            else:
                a, b = b, a ^ (_number(key, f"{label}|{r}|{b}") & mask)
        x = a << half | b
        if x < size:
            return x


def cycled(x: int, size: int, key: bytes, label: str) -> int:
    """The next value after x in a keyed cycle through 0 .. size - 1."""
    if size < 2:
        return x
    at = _feistel(x, size, key, label, range(8))
    return _feistel((at + 1) % size, size, key, label, range(7, -1, -1))


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(re.sub(r"\D", "", digits))):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _places(kind: str, value: str) -> list[str] | list[list[str]]:
    """What may stand at each place; a single choice is fixed."""
    if kind == "ipv4":
        out: list[list[str]] = []
        for octet in value.split("."):
            low, high = {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(octet)]
            out += [[str(v) for v in range(low, high + 1)], ["."]]
        return out[:-1]
    if kind == "ipv6":  # a group keeps its length, so it never becomes one that is written otherwise
        return [c if c == ":" or c == "0" and value[k - 1 : k] in ("", ":") else _HEX[1:] if value[k - 1 : k] in ("", ":") else _HEX for k, c in enumerate(value)]
    fixed = set()
    if kind == "email":  # the top-level domain
        fixed = set(range(value.rindex("."), len(value)))
    elif kind == "phone" and value[0] == "+":  # the country code
        fixed = set(range(re.match(r"\+\d*", value).end()))
    elif kind == "iban":  # the country; its check digits are made afterwards
        fixed = set(range(4))
    out = []
    for k, c in enumerate(value):
        choice = letter_class(c)
        if k in fixed:
            out.append(c)
        elif choice == _DIGITS and value[k + 1 : k + 2] in tuple(_DIGITS) and value[k - 1 : k] not in tuple(_DIGITS):
            out.append("0" if c == "0" else "123456789")  # a group of digits keeps its leading zero, or goes on without; were either free, the two could meet
        else:
            out.append(choice)
    return out


def _permuted(tokens: list[str], places: list, key: bytes, label: str) -> str:
    """Another string of the same places: the next in a cycle through all of them. Of one choice in all, the same."""
    size, x, shape = 1, 0, [label]
    for choice, token in zip(places, tokens, strict=True):
        x = x * len(choice) + choice.index(token)
        size *= len(choice)
        shape.append(token if len(choice) == 1 else f"{len(choice)}{choice[0]}")
    x = cycled(x, size, key, "/".join(shape))
    out = []
    for choice in reversed(places):
        x, k = divmod(x, len(choice))
        out.append(choice[k])
    return "".join(reversed(out))


@lru_cache(maxsize=50_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of a canonical form."""
    if kind == "person":
        return _person(value, key)
    if kind == "card":  # the last digit follows from the others and the Luhn remainder
        check, body = _luhn(value), value[:-1]
        made = _card(body, key, f"card|{check}", issued(re.sub(r"\D", "", value)))
        return next(made + c for c in _DIGITS if _luhn(made + c) == check)
    if kind == "iban":
        body = value[:2] + "00" + value[4:]
        made = _permuted(list(body), _places(kind, body), key, kind)
        return f"{made[:2]}{98 - _remainder(made.replace(' ', '')):02d}{made[4:]}"
    places = _places(kind, value)
    tokens = value.replace(".", "\0.\0").split("\0") if kind == "ipv4" else list(value)
    made = _permuted(tokens, places, key, kind)
    if kind == "email" and made == value:  # no letter or digit to change
        return hmac.digest(key, value.encode(), "sha256").hex() + value[value.index("@") :]
    return made


def _card(body: str, key: bytes, label: str, of_issuer: bool) -> str:
    """Permuted until the number is an issuer's again, if it was, and isn't if it wasn't, so that it is found as a card."""
    places = [*_places("card", body)]
    made = body
    while True:
        made = _permuted(list(made), places, key, label)
        if issued(re.sub(r"\D", "", made) + "0") == of_issuer:
            return made


def _surname(name: str, key: bytes, fixed: int = 0) -> str:
    """A name permuted by sounds; its last ``fixed`` letters stay. Each part of a hyphenated one by itself."""
    out = []
    for part in name.split("-"):
        low = part.lower()
        places = [c if k >= len(low) - fixed else _SOUNDS.get(c) or letter_class(c) for k, c in enumerate(low)]
        out.append(_permuted(list(low), places, key, "name").capitalize())
    return "-".join(out)


def _given(name: str, surname: str, key: bytes) -> str:
    out = []
    for k, part in enumerate(name.split("-")):
        if part in _OF_NAME:
            names = GIVEN[_OF_NAME[part]]
            out.append(names[cycled(names.index(part), len(names), key, f"given|{k}|{surname}")])
            continue
        made = part
        while True:  # a permutation, so it comes back to the part itself at worst, which isn't listed
            made = _surname(made, key, 1 if len(part) > 3 else 0)
            if made not in _OF_NAME:
                break
        out.append(made)
    return "-".join(out)


def _person(value: str, key: bytes) -> str:
    given, rest = value.split(" ", 1)
    surnames = " ".join(_surname(x, key) for x in rest.split(" "))
    return f"{_given(given, rest, key)} {surnames}" if given else surnames


def _answer(kind: str, value: str, written: str, key: bytes) -> str:
    if kind != "person":
        return surrogate(kind, value, key)
    full, _, part = value.partition("\0")
    made = surrogate(kind, full, key)
    if part:
        given, rest = full.split(" ", 1)
        words, ours = rest.split(" "), made.split(" ")[1:] if full[0] != " " else made.split(" ")
        made = made.split(" ")[0] if part == given else " ".join(ours) if part == rest else ours[words.index(part)]
    return made.upper() if written.isupper() and len(written) > 1 else made


@dataclass(frozen=True)
class Replaced:
    text: str | None
    counts: tuple[int, ...]


def replace(text: str | None, key: bytes) -> Replaced:
    """The text with surrogates, and how many entities of each kind it had."""
    if not text:
        return Replaced(text, (0,) * len(KINDS))
    found = entities(text)
    out, end = [], 0
    for a, b, kind, value in found:
        out += [text[end:a], _answer(kind, value, text[a:b], key)]
        end = b
    kinds = [kind for _, _, kind, _ in found]
    return Replaced("".join([*out, text[end:]]), tuple(kinds.count(k) for k in KINDS))


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The collision check: kind, surrogate and n_values of the surrogates that several values of a kind share. None should be found.

    Values are made distinct before they are counted, so a value of any frequency is one row.
    """

    def run(batches):
        for batch in batches:
            found = {(kind, value.partition("\0")[0]) for t in batch.column(0).to_pylist() if t for _, _, kind, value in entities(t)}
            rows = sorted((kind, value, surrogate(kind, value, key)) for kind, value in found)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["kind", "value", "surrogate"])

    found = common.in_batches(docs.select(F.col(text_col)), run, "kind string, value string, surrogate string").distinct()
    return found.groupBy("kind", "surrogate").agg(F.count("*").alias("n_values")).where("n_values > 1")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns in ``keep``, text with surrogates, and a count for each kind (n_email and so on).

    A column in ``keep`` that is named like one of the others gets a leading underscore.
    """
    made_names = ("text", *(f"n_{k}" for k in KINDS))

    def run(batches):
        for batch in batches:
            made = [replace(t, key) for t in batch.column(0).to_pylist()]
            counts = [pa.array([m.counts[k] for m in made], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([m.text for m in made], pa.string()), *counts], names=[*batch.schema.names[1:], *made_names])

    chosen = docs.select(F.col(text_col).alias("_text_"), F.col(id_col).alias("doc_id"), *common.kept(keep, ("doc_id", *made_names)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return common.in_batches(chosen, run, f"{kinds}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(common.table(spark, sf_dir, "documents"), DEMO_KEY)


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates}
ORACLE: dict[str, str] = {}
