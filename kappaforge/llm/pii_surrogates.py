"""Personal data replaced by keyed, type-consistent surrogates.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards (Luhn),
IBANs (mod 97), social security numbers, secrets assigned to a named key, and
personal names after a title, a known given name or a phrase that introduces
one; a name found in a document is replaced wherever one of its parts stands
there, alone too. Each distinct value gets one surrogate in all documents and
in all its formats, so mentions stay coreferent; the parts of a name are values
of their own, so "Mr Weber" and "Karl Weber" share a surname.

Values of a format are permuted among themselves: a keyed Feistel permutation
of the format's own space, so that a surrogate has the same kind, separators,
case, script, country code and check digits, and two values of a format never
share one. Names are made of syllables in the same script, with the same gender
of given name and of surname ending ("Иванов" and "Иванова" keep one stem).

Collision checks run over the distinct values of the whole corpus: a surrogate
may be no surrogate of another value, and no value that occurs. A value that
collides is drawn again, round after round, until none does; only those values
need a table when texts are rewritten. A format whose values fill over a
quarter of its space, such as all addresses x@y.com, keeps the permutation as
it is: its surrogates are distinct and never the value itself, but may be other
values that occur.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaforge.llm.store import unused, written
from kappaforge.llm.words import blocks

#: redrawn values up to this number are broadcast; more are joined
MAX_BROADCAST = 20_000
#: share of a format's space above which its surrogates may be values that occur
CROWDED = 0.25

#: given names with gender, by script (fixed values)
GIVEN = {
    "f": (
        "Alice", "Amanda", "Angela", "Anna", "Barbara", "Carmen", "Caroline", "Catherine", "Claire", "Claudia", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Hannah", "Isabelle", "Jennifer", "Jessica", "Julia", "Karen", "Katharina",
        "Laura", "Linda", "Lisa", "Lucia", "Margaret", "Maria", "Marie", "Mary", "Michelle", "Monika", "Nancy", "Patricia", "Sabine", "Sandra", "Sarah", "Sofia", "Sophie", "Stefanie", "Susan", "Ursula",
        "Анастасия", "Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Ελένη", "Κατερίνα", "Μαρία",
    ),
    "m": (
        "Ahmed", "Alexander", "Andrew", "Antonio", "Benjamin", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Fernando", "Francisco", "François", "Georg", "George", "Hans", "James", "Javier", "Jean", "John", "José", "Joseph", "Juan", "Jürgen",
        "Karl", "Kevin", "Klaus", "Luis", "Matthew", "Michael", "Miguel", "Mohammed", "Nicolas", "Patrick", "Paul", "Peter", "Philippe", "Pierre", "Ricardo", "Richard", "Robert", "Stefan", "Steven", "Thomas", "William", "Wolfgang",
        "Александр", "Алексей", "Андрей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Γιώργος", "Δημήτρης", "Νίκος",
    ),
}
#: titles that stand before a name, with gender where they tell it (fixed values)
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Signor": "m", "Signora": "f",
    "Dr": "", "Prof": "", "Professor": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: phrases that introduce a full name (fixed values)
CUES = ("my name is", "name:", "Name:", "signed by", "Signed,", "Dear", "Kind regards,", "Best regards,", "Sincerely,", "mein Name ist", "ich heiße", "Sehr geehrter", "Sehr geehrte", "je m'appelle", "me llamo", "mi nombre es", "Меня зовут", "меня зовут")

_GENDER = {name: g for g, names in GIVEN.items() for name in names}
_NAME = r"[^\W\d_a-zа-яß-öø-ÿ]\w*(?:[-'’]\w+)*"
_PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}")),
    ("secret", re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_/+.=-]{8,})")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("card", re.compile(r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")),
]
_INITIALS = r"(?:[  ][^\W\d_a-zа-я]\.)*"
_PARTICLES = r"(?:[  ](?:von|van|vom|zu|de|del|della|der|den|di|da|la|le|du|bin|ibn))*"
_REST = rf"((?:{_INITIALS}{_PARTICLES}[  ]{_NAME}){{1,3}})"
_PERSON = re.compile(rf"\b(?:({'|'.join(TITLES)})\b\.?|({'|'.join(_GENDER)})\b){_REST}")
_CUED = re.compile(rf"(?:\b(?:{'|'.join(map(re.escape, CUES))}))\s+({_NAME})((?:{_INITIALS}{_PARTICLES}[  ]{_NAME}){{1,2}})")
_WORD = re.compile(_NAME)
# what a text must hold to be looked at closely; a pattern of capital first letters passes over most of a text quickly
_HINTS = re.compile("|".join(sorted(re.escape(x) for x in (*TITLES, *_GENDER, *CUES) if x[0].isupper())))
_LOW_CUES = tuple(x for x in CUES if not x[0].isupper())
_HEXADECIMAL = re.compile("[0-9a-f]+|[0-9A-F]+")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_SECRETS = ("secret", "passw", "token", "auth", "key")

#: country calling codes of one and two digits; all others have three (fixed values)
_SHORT_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
#: feminine and masculine endings of surnames that have both (fixed values)
_PAIRED = (("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ына", "ын"), ("ская", "ский"), ("цкая", "цкий"), ("ая", "ый"), ("ska", "ski"), ("cka", "cki"))


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def normal(kind: str, text: str) -> str | None:
    """Normal form of a value, the same for all its formats; None if it is no such value after all."""
    if kind == "card":
        d = re.sub(r"\D", "", text)
        return d if 13 <= len(d) <= 19 and d[0] in "3456" + "2" and (d[0] != "2" or "22" <= d[:2] <= "27") and _luhn(d) else None
    if kind == "iban":
        v = text.replace(" ", "")
        return v if 15 <= len(v) <= 34 and _mod97(v) == 1 else None
    if kind == "ip":
        parts = text.split(".")
        return text if all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts) else None
    if kind in ("phone", "ssn"):
        d = re.sub(r"\D", "", text)
        if kind == "ssn":
            return d
        if not 7 <= len(d) <= 15:
            return None
        d = d[1:] if len(d) == 11 and d[0] == "1" else d
        return f"+{d}" if text.startswith("+") and not text.startswith("+1") else d
    if kind == "email":
        return text.lower()
    if kind == "secret":
        return text if len(set(text)) >= 5 else None
    return text.casefold()


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, normal form) of what is found, in order, without overlaps; the first pattern to claim a place has it."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order; none overlaps another

    def claim(a: int, b: int, kind: str) -> None:
        at = bisect(taken, (a, b))
        if at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b:
            return
        value = normal(kind, text[a:b])
        if value is not None:
            taken.insert(at, (a, b))
            found.append((a, b, kind, value))

    digits, low = _DIGIT_OR_AT.search(text), text.lower()
    secrets = any(x in low for x in _SECRETS)
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text) if (secrets if kind == "secret" else digits) else ():
            claim(*m.span(m.lastindex or 0), kind)
    if not _HINTS.search(text) and not any(x in text for x in _LOW_CUES):
        return sorted(found)
    for m in _PERSON.finditer(text):
        title, given, _ = m.groups()
        if given:
            claim(*m.span(2), "given_" + _GENDER[given])
        words = [w.span() for w in _WORD.finditer(text, *m.span(3)) if w.end() - w.start() > 1 or text[w.end() : w.end() + 1] != "."]
        for k, (a, b) in enumerate(words):
            gender = _GENDER.get(text[a:b]) if k + 1 < len(words) else None
            if title and k == 0 and len(words) > 1 and not gender:
                gender = TITLES[title] or None
            claim(a, b, f"given_{gender}" if gender else "surname")
    for m in _CUED.finditer(text):
        if m[1] not in TITLES:
            claim(*m.span(1), f"given_{_GENDER[m[1]]}" if m[1] in _GENDER else "given_")
            for w in _WORD.finditer(text, *m.span(2)):
                if w.end() - w.start() > 1 or text[w.end() : w.end() + 1] != ".":
                    claim(*w.span(), "surname")
    # parts of the names found, wherever else they stand
    parts = {value: kind for _, _, kind, value in found if space(kind) == "name" and len(value) > 1}
    if parts:
        starts = {a for a, *_ in found}
        for w in _WORD.finditer(text):
            if w.start() not in starts and (kind := parts.get(w[0].casefold())):
                claim(*w.span(), kind)
    return sorted(found)


def space(kind: str) -> str:
    """Kinds whose values must differ from each other share a space."""
    return "name" if kind.startswith("given") or kind == "surname" else kind


_DIGITS, _HEX = tuple("0123456789"), tuple("abcdef")
_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ")
_OCTETS = {1: tuple(map(str, range(10))), 2: tuple(map(str, range(10, 100))), 3: tuple(map(str, range(100, 256)))}
_AREAS = tuple(f"{k:03d}" for k in range(1, 900) if k != 666)
_NO_AREAS = ("000", "666", *(str(k) for k in range(900, 1000)))


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> tuple[str, ...]:
    """The characters of the same script and case; only itself where it has none."""
    if c.isdecimal() and c.isascii():
        return _DIGITS
    for letters in _LETTERS:
        if c in letters:
            return tuple(letters)
        if c.lower() in letters and len(c.lower()) == 1:
            return tuple(x for x in (y.upper() for y in letters) if len(x) == 1)
    return (c,)


def _fixed(text: str) -> list[tuple[str, tuple[str, ...]]]:
    return [(c, (c,)) for c in text]


def _free(text: str) -> list[tuple[str, tuple[str, ...]]]:
    return [(c, _alphabet(c)) for c in text]


def layout(kind: str, value: str) -> list[tuple[str, tuple[str, ...]]]:
    """The parts of a value, each with the parts that may stand in its place; check digits are fixed as '?'."""
    if kind == "card":
        keep = 2 if value[0] == "2" else 1
        return [*_fixed(value[:keep]), *_free(value[keep:-1]), *_fixed("?")]
    if kind == "iban":
        return [*_fixed(value[:2] + "??"), *_free(value[4:])]
    if kind == "ip":
        parts = [(p, _OCTETS[len(p)]) for p in value.split(".")]
        return [x for p in parts for x in (p, (".", (".",)))][:-1]
    if kind == "ssn":
        area, group, serial = value[:3], value[3:5], value[5:]
        return [(area, _NO_AREAS if area in _NO_AREAS else _AREAS), (group, _pairs(1) if group != "00" else ("00",)), *([(serial[:2], _pairs(0)), (serial[2:], _pairs(1))] if serial[2:] != "00" else [*_free(serial[:2]), *_fixed("00")])]
    if kind == "phone":
        code = ""
        if value[0] == "+":
            code = next((value[: 1 + n] for n in (1, 2) if value[1 : 1 + n] in _SHORT_CODES), value[:4])
        first, rest = value[len(code) : len(code) + 1], value[len(code) + 1 :]
        return [*_fixed(code), (first, _DIGITS[2:] if first >= "2" else (first,)), *_free(rest)]
    if kind == "email":
        name, dot, top = value.rpartition(".")
        return [*_free(name), *_fixed(dot + top)]
    if _HEXADECIMAL.fullmatch(value):
        return [(c, _DIGITS if c.isdecimal() else _HEX if c.islower() else tuple("ABCDEF")) for c in value]
    return _free(value)


@lru_cache(maxsize=2)
def _pairs(low: int) -> tuple[str, ...]:
    return tuple(f"{k:02d}" for k in range(low, 100))


def form(kind: str, value: str) -> tuple[str, float]:
    """The format of a value, equal for the values that are permuted among themselves, and how many it has."""
    if space(kind) == "name":
        return "name", float("inf")
    parts = layout(kind, value)
    room = 1
    for _, some in parts:
        room *= len(some)
    # the first and the number of the choices tell an alphabet
    return kind + "".join(f"|{some[0]}" if len(some) == 1 else f"|{some[0]}-{len(some)}" for _, some in parts), float(min(room, 10**300))


def _feistel(x: int, half: int, key: bytes, back: bool = False) -> int:
    """Eight keyed rounds over numbers of twice ``half`` bits."""
    mask, size = (1 << half) - 1, (half + 7) // 8
    left, right = x >> half, x & mask
    for k in reversed(range(8)) if back else range(8):
        if back:
            left, right = right, left
        left, right = right, left ^ int.from_bytes(hashlib.shake_256(key + bytes([k]) + right.to_bytes(size, "big")).digest(size), "big") & mask
        if back:
            left, right = right, left
    return left << half | right


def _moved(x: int, n: int, key: bytes, draw: int) -> int:
    """Another number below ``n``: one step along a keyed cycle of them all, another step for every draw."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)

    def walk(v: int, back: bool) -> int:
        v = _feistel(v, half, key, back)
        while v >= n:
            v = _feistel(v, half, key, back)
        return v

    step = 1 + int.from_bytes(hashlib.shake_256(key + b"step%d" % draw).digest(40), "big") % (n - 1)
    return walk((walk(x, False) + step) % n, True)


def permuted(kind: str, value: str, draw: int, key: bytes) -> str:
    """The surrogate of a value in a format of its own space; different values of a format have different ones."""
    parts = layout(kind, value)
    own = hmac.new(key, form(kind, value)[0].encode(), hashlib.sha256).digest()
    at, room = 0, 1
    for c, some in parts:
        at, room = at * len(some) + (some.index(c) if len(some) > 1 else 0), room * len(some)
    mixed = kind == "secret" and not _HEXADECIMAL.fullmatch(value)
    while True:
        at = left = _moved(at, room, own, draw)
        out = []
        for _, some in reversed(parts):
            left, k = divmod(left, len(some))
            out.append(some[k])
        new = "".join(reversed(out))
        # secrets of hexadecimal digits are a format of their own
        if not mixed or not _HEXADECIMAL.fullmatch(new):
            break
    if kind == "card":
        return next(new[:-1] + c for c in "0123456789" if _luhn(new[:-1] + c))
    if kind == "iban":
        body = new[:2] + "00" + new[4:]
        return new[:2] + f"{98 - _mod97(body):02d}" + new[4:]
    return new


#: syllables of made-up names, and endings of given names by gender and of surnames, by script (fixed values)
_SYLLABLES = {
    "latin": (
        ("al", "be", "ca", "da", "el", "fa", "gor", "hal", "in", "jo", "kel", "lor", "mi", "na", "or", "pel", "quin", "ros", "sel", "tam", "ul", "ven", "wil", "yar", "zan", "bri", "dor", "fen", "gre", "lan"),
        {"f": ("a", "ina", "elle", "ia"), "m": ("o", "us", "er", "en"), "": ("son", "berg", "ton", "mann", "ez", "ier")},
    ),
    "cyrillic": (
        ("ал", "бе", "ва", "гор", "да", "ел", "жи", "за", "ил", "ка", "лев", "ми", "на", "ор", "пе", "рос", "се", "та", "ул", "фе", "хар", "це", "ча", "шу"),
        {"f": ("а", "ина", "ия"), "m": ("ий", "ей", "ан"), "": ("енко", "юк", "ко")},
    ),
    "greek": (
        ("αλ", "βε", "γα", "δη", "ελ", "ζω", "θε", "ιλ", "κα", "λε", "μι", "να", "ορ", "πε", "ρο", "σε", "τα", "φι", "χα"),
        {"f": ("α", "η", "ια"), "m": ("ος", "ης", "ας"), "": ("ιδης", "ακης", "ου")},
    ),
}


def named(kind: str, value: str, draw: int, key: bytes) -> str:
    """A made-up name of the same script and gender; longer after every fourth draw."""
    script = "cyrillic" if re.search("[Ѐ-ӿ]", value) else "greek" if re.search("[Ͱ-Ͽ]", value) else "latin"
    syllables, endings = _SYLLABLES[script]
    ends, stem = endings[kind[6:] if kind.startswith("given_") else ""], value
    if kind == "surname":
        # a surname with two forms is drawn by its masculine one and ends alike
        pair = next((p for p in _PAIRED if value.endswith(p) and len(value) > 4), None)
        if pair:
            feminine = value.endswith(pair[0])
            stem, ends = value[: -len(pair[0])] + pair[1] if feminine else value, (pair[0] if feminine else pair[1],)
    seed = hmac.new(key, f"{kind}\0{stem}\0{draw}".encode(), hashlib.sha256).digest()
    pool = int.from_bytes(hashlib.shake_256(seed).digest(16 + 4 * (draw // 4)), "big")
    pool, more = divmod(pool, 2)
    out = []
    for _ in range(2 + more + draw // 4):
        pool, k = divmod(pool, len(syllables))
        out.append(syllables[k])
    return "".join(out) + ends[pool % len(ends)]


def surrogate(kind: str, value: str, draw: int, key: bytes) -> str:
    """Normal form of the surrogate of a value; another for every draw."""
    return (named if space(kind) == "name" else permuted)(kind, value, draw, key)


def shaped(text: str, value: str, kind: str) -> str:
    """The surrogate ``value`` in the format of the mention ``text``."""
    if kind in ("card", "phone", "ssn", "iban"):
        left, out = list(value.lstrip("+")), []
        for c in reversed(text):
            out.append(left.pop() if (c.isdecimal() or kind == "iban" and c.isalpha()) and left else c)
        return "".join(reversed(out))
    if kind == "email":
        return value.upper() if text.isupper() else value
    if space(kind) == "name":
        return value.upper() if text.isupper() and len(text) > 1 else value.capitalize()
    return value


def _rewrite(text: str, draws: dict[tuple[str, str], int], key: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    out, at, done = [], 0, []
    for a, b, kind, value in entities(text):
        new = shaped(text[a:b], surrogate(kind, value, draws.get((kind, value), 0), key), kind)
        out += [text[at:a], new]
        at = b
        done.append((a, b, kind, new))
    return "".join([*out, text[at:]]), done


def distinct_values(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value) of all documents, each once, with partial sums before the shuffle."""
    part = docs.select(F.col(text).alias("_text")).where("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(kind, value) for t in batch.column("_text") for _, _, kind, value in entities(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    return part.mapInArrow(run, "kind string, value string").distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows`` (kind, value, draw) with their space, surrogate, format and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v, n = (batch.column(c).to_pylist() for c in ("kind", "value", "draw"))
            forms = [form(*x) for x in zip(k, v)]
            more = [pa.array([space(x) for x in k], pa.string()), pa.array([surrogate(*x, key) for x in zip(k, v, n)], pa.string()), pa.array([x for x, _ in forms], pa.string()), pa.array([x for _, x in forms], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["kind", "value", "draw", "space", "new", "form", "room"])

    return rows.select("kind", "value", "draw").mapInArrow(run, "kind string, value string, draw int, space string, new string, form string, room double")


def redrawn(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, draw) of the values whose first surrogate collides, with the draw that does not."""
    settled = written(_drawn(values.select("kind", "value", F.lit(0).alias("draw")), key), "drawn")
    real = settled.select("space", F.col("value").alias("new"))
    crowded = settled.groupBy("form").agg(F.count("*").alias("n"), F.first("room").alias("room")).where(F.col("n") > CROWDED * F.col("room")).select("form")
    rank, place = F.struct("kind", "value"), ["space", "new"]

    def colliding(rows: DataFrame, others: DataFrame | None) -> DataFrame:
        # of equal surrogates the smallest value keeps its own: a pre-aggregated minimum, no group in one task
        first = rows.groupBy(*place).agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
        double = rows.join(first, place).where(rank != F.col("first"))
        found = double.select("kind", "value").unionByName(rows.join(real, place, "left_semi").join(crowded, "form", "left_anti").select("kind", "value"))
        if others is not None:
            found = found.unionByName(rows.join(others.select(*place), place, "left_semi").select("kind", "value"))
        return written(found.distinct(), "again")

    again, fresh, done = colliding(settled, None), settled, []
    base = settled.join(again, ["kind", "value"], "left_anti")
    while again.take(1):
        fresh = written(_drawn(fresh.join(again, ["kind", "value"], "left_semi").withColumn("draw", F.col("draw") + 1), key), "drawn")
        others = base
        for x in done:
            others = others.unionByName(x)
        again = colliding(fresh, others)
        done.append(written(fresh.join(again, ["kind", "value"], "left_anti"), "settled"))
    out = base.limit(0)
    for x in done:
        out = out.unionByName(x)
    return out.select("kind", "value", "draw")


def _digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()[:16]


def rewrite(docs: DataFrame, key: bytes, text: str = "text", report: bool = False, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with surrogates in ``text``, all other columns unchanged.

    Who knows ``key`` can tell which value a surrogate stands for. With ``report``
    the columns n_entities, kinds and entities (start, stop and kind in the input,
    surrogate) are added, under names with underscores where ``docs`` has them.
    Null texts stay null, empty ones empty; repeated rows stay and read alike; an
    empty table stays empty. Columns may have any names.
    """
    spark = docs.sparkSession
    special = redrawn(distinct_values(docs, text), key)
    few = special.limit(max_broadcast + 1).count() <= max_broadcast
    shared = spark.sparkContext.broadcast({(r.kind, r.value): r.draw for r in special.collect()} if few else {})
    names = docs.columns
    digest, draws_of = unused(names, "digest", "draws")
    added = unused(names, "n_entities", "kinds", "entities")
    frame = docs
    if not few:  # the draws of a text's values come to it by the digest of the text
        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {(_digest(t.as_py()), kind, value) for t in batch.column("text") for _, _, kind, value in entities(t.as_py())}
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), *(pa.array([x[k] for x in found], pa.string()) for k in (1, 2))], names=["digest", "kind", "value"])

        own = docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(mentions, "digest binary, kind string, value string").distinct()
        draws = own.join(special, ["kind", "value"]).groupBy(F.col("digest").alias(digest)).agg(F.collect_list(F.struct("kind", "value", "draw")).alias(draws_of))
        frame = docs.withColumn(digest, F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))).join(draws, digest, "left").select(*names, draws_of)
    struct = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in blocks(batch, text):
                new, found = [], []
                for k, t in enumerate(rows.column(text)):
                    draws = shared.value
                    if not few and rows.column(draws_of)[k].is_valid:
                        draws = {(x["kind"], x["value"]): x["draw"] for x in rows.column(draws_of)[k].as_py()}
                    value, done = (None, []) if not t.is_valid else _rewrite(t.as_py(), draws, key)
                    new.append(value)
                    found.append(done)
                columns = [pa.array(new, rows.schema.field(text).type) if c == text else rows.column(c) for c in names]
                if report:
                    n = pa.array([len(x) for x in found], pa.int64())
                    kinds = pa.array([",".join(sorted({e[2] for e in x})) for x in found])
                    columns += [n, kinds, pa.array([[dict(zip(("start", "stop", "kind", "surrogate"), e)) for e in x] for x in found], struct)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added][: len(columns)])

    schema = docs.schema
    if report:
        kinds_of = ("long", "string", "array<struct<start:bigint,stop:bigint,kind:string,surrogate:string>>")
        schema = T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in zip(added, kinds_of))).fields])
    return frame.mapInArrow(run, schema)


def surrogates(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """doc_id, text (rewritten), n_entities, kinds and entities of every row."""
    return rewrite(docs.select("doc_id", F.col(text).alias("text")), key, report=True)
