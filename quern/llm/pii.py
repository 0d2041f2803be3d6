"""PII: detected entities are replaced by keyed surrogates of the same type and format.

A surrogate comes from a keyed bijection of the entity's own domain (strings of the same shape, a list of
names of the same gender and script, numbers of the same length), built as one cycle: a Feistel network P
over the domain gives x -> P^-1(P(x) + 1).  So distinct entities get distinct surrogates, equal ones equal
surrogates in all documents, and nothing stays as it was, without any table of the corpus.

What is mapped is the entity, not its spelling: an address without regard to case, a number without its blanks
and signs, a telephone number without its country or trunk prefix, a name without regard to case; digits of all scripts are
read alike and written as they stood.  Dates and ranges of years are no telephone numbers.  The
surrogate is then written in the form of the mention, so all mentions of an entity stay together.  Check digits
follow from the mapped body; a wrong check digit stays wrong by the same difference.  Walks on the cycle pass
over values that are not allowed (listed names, reserved addresses), which keeps the map one to one.
``collisions`` checks this over a corpus, and ``checked`` refuses a result that fails.

Persons are found by lists and cues, not by a model: a listed first name (and the capitalised word behind it), the
words behind a title, before a listed surname, behind phrases such as "my name is", before "said" or an e-mail
address, and Han or Hangul names by surname, honorific or phrase.  Further whole-word mentions of the same names in
the document get the same surrogates.  Names without any of these stay.

Results that are defined: a null text stays null; texts without entities stay as they are; repeated rows
give equal results; the time for a text of any length grows in proportion to it; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quern.llm.common import map_text, narrow
from quern.runtime import cut

#: Listed first names by script and gender.
FIRST_NAMES = {
    ("latin", "f"): "Alice Anna Astrid Beatrice Carla Carmen Charlotte Clara Diana Elena Elisabeth Emily Emma Eva Greta Hannah Helen Ingrid Isabel Jane Julia Karin Laura Lena Lisa Louise Lucia Maria Marie Martha Mary Mónica Nina Olivia Paula Rosa Sarah Sofia Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Albert Alexander Andreas Anton Arthur Carlos Charles Daniel David Diego Edward Erik Felix Fernando François Frank George Hans Henri Hugo Jack James Jean Johann John José Juan Karl Louis Lukas Marco Martin Michael Miguel Oliver Oscar Paul Pedro Peter Pierre Robert Stefan Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Фёдор Юрий".split(),
    ("greek", "f"): "Αγγελική Αικατερίνη Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Σπύρος".split(),
}
TITLES = ("Mrs", "Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Madame", "Mme", "Monsieur", "Señora", "Señor", "Sra", "Sr")

#: Surnames that make the capitalised word before them a name.
SURNAMES = frozenset(
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann "
    "Dupont Dubois Moreau Laurent García Martínez López Sánchez Pérez González Rodríguez Hernández Rossi Ferrari Bianchi Silva Santos Oliveira "
    "Nguyen Nguyễn Tran Trần Pham Sato Suzuki Takahashi Tanaka Watanabe Ito Yamamoto Nakamura Kobayashi Kato Wang Zhang Liu Chen Yang Huang Zhao "
    "Kim Choi Jung Singh Kumar Sharma Gupta Patel Khan Ahmed Hassan Hussein Ibrahim Kowalski Nowak Ivanov Petrov Novák Kovács Jensen Hansen Larsson".split()
)
#: Phrases before a name, without what separates them.
CUES = (
    "my name is", "his name is", "her name is", "contact person", "signed by", "yours sincerely", "sincerely", "kind regards", "best regards", "dear",
    "mein name ist", "ich heiße", "mit freundlichen grüßen", "sehr geehrter", "sehr geehrte", "je m'appelle", "cordialement", "me llamo", "mi nombre es", "atentamente", "меня зовут", "с уважением",
)
#: Capitalised words that follow such phrases and are no names.
NO_NAMES = frozenset("Sir Madam Sirs All Team Customer Customers Colleague Colleagues Friend Friends Reader Readers Everyone Editor The And Damen Herren Kunde Kunden Name Date Address Phone Email".split())
SAID = (" said", " says", " wrote", " writes", " told ", " asked", " replied", " sagte", " schrieb", " dijo", " escribió", " a dit", " a écrit", " сказал")
HAN_SURNAMES = "佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤 吉田 山田 佐々木 松本 井上 木村 清水 欧阳 司马 上官 诸葛".split()

_LISTED = {name: key for key, names in FIRST_NAMES.items() for name in names}
_SPELT = {spelt: name for name in _LISTED for spelt in (name, name.upper())}
_TITLES = frozenset(TITLES)
#: Words that begin with a capital letter, or are of a script without case.
_CAPITAL = re.compile(r"(?<!\w)[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[-'’][^\W\d_]+)*")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_EAST = re.compile(r"[\u4e00-\u9fff\uac00-\ud7a3]")
_HAN = re.compile(
    rf"(?:{'|'.join(HAN_SURNAMES)})[\u4e00-\u9fff]{{1,2}}|[\u4e00-\u9fff]{{2,4}}(?=さん|様|氏|先生|女士)|(?<=我叫)[\u4e00-\u9fff]{{2,3}}|(?<=姓名[::])[\u4e00-\u9fff]{{2,4}}|[\uac00-\ud7a3]{{2,4}}(?= ?(?:씨|님))"
)
#: In this order; a later kind never overlaps an earlier one.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:(?:[^\W_]|-)+\.)+[^\W\d_]{2,}(?![\w-])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f:]{2,39}(?![\w:]|\.\d)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,12}(?:[ .-]\d{1,9}){0,4}|(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4})(?![\w-])")),
]

# ------------------------------------------------------------------- keyed bijections


class Cycle:
    """One keyed cycle through 0 .. size - 1: no fixed point where size > 1."""

    ROUNDS = 6

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.size, self.key = size, hmac.new(key, f"{label}:{size}".encode(), hashlib.sha256).digest()
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)

    def _round(self, i: int, x: int) -> int:
        data = i.to_bytes(1, "big") + x.to_bytes((self.half + 7) // 8, "big")
        out = b""
        while len(out) * 8 < self.half:
            out += hmac.new(self.key, data + len(out).to_bytes(2, "big"), hashlib.sha256).digest()
        return int.from_bytes(out, "big") & ((1 << self.half) - 1)

    def _network(self, x: int, rounds) -> int:
        mask = (1 << self.half) - 1
        a, b = x >> self.half, x & mask
        for i in rounds:
            a, b = b, a ^ self._round(i, b)
        return b << self.half | a  # swapped, so that the reverse order of rounds undoes it

    def _walk(self, x: int, rounds) -> int:
        x = self._network(x, rounds)
        while x >= self.size:
            x = self._network(x, rounds)
        return x

    def next(self, x: int) -> int:
        y = (self._walk(x, range(self.ROUNDS)) + 1) % self.size
        return self._walk(y, range(self.ROUNDS - 1, -1, -1))


#: Signs that may be all of the name in an e-mail address.
SIGNS = "%+-_"

_VOWELS = {"latin": "aeiouy", "cyrillic": "аеёиоуыэюя", "greek": "αεηιουω"}


#: Other letters are exchanged within their range and case.
_RANGES = ((0xC0, 0x17F), (0x370, 0x3FF), (0x400, 0x4FF), (0x531, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x1E00, 0x1EFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


@lru_cache(maxsize=None)
def _classes() -> dict[str, str]:
    """For each replaceable character all characters of its class, in order."""
    found: dict[str, str] = {}
    digits = "0123456789"
    found |= dict.fromkeys(digits, digits)
    scripts = {"latin": [chr(c) for c in range(ord("a"), ord("z") + 1)], "cyrillic": [chr(c) for c in range(0x430, 0x450)], "greek": [chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2]}
    for script, letters in scripts.items():
        for vowel in (True, False):
            own = "".join(c for c in letters if (c in _VOWELS[script]) == vowel)
            found |= dict.fromkeys(own, own)
            found |= dict.fromkeys(own.upper(), own.upper())
    for low, high in _RANGES:
        by_kind: dict[str, list[str]] = {}
        for c in map(chr, range(low, high + 1)):
            kind = unicodedata.category(c)
            if c not in found and kind in ("Lo", "Ll", "Lu") and (kind == "Lo" or len(c.lower()) == len(c.upper()) == 1 and c.lower() != c.upper() and c.lower().upper() == c.upper() and c.upper().lower() == c.lower()):
                by_kind.setdefault(kind, []).append(c)
        # Capital letters are exchanged as their small ones are, so that case can be put back.
        small = "".join(x for x in by_kind.get("Ll", []) if x.upper() in by_kind.get("Lu", []))
        for own in (small, small.upper(), "".join(by_kind.get("Lo", []))):
            if len(own) > 1:
                found |= dict.fromkeys(own, own)
    return found


@lru_cache(maxsize=None)
def _others() -> dict[str, str]:
    """Classes of all further letters, digits and numerals: by block, category and whether case goes there and back.

    Every character is of one class, of at least two: what is alone in its block is put together with its like.
    """
    known, kinds = _classes(), {}
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind[0] not in "LN" or c in known:
            continue
        if kind == "Nd":
            key = (kind, ord(c) - unicodedata.decimal(c), True)
        else:
            key = (kind, ord(c) >> 8, len(c.lower()) == len(c.upper()) == 1 and c.upper().lower() == c.lower() and c.lower().upper() == c.upper())
        kinds.setdefault(key, []).append(c)
    alone: dict[tuple, list[str]] = {}
    for (kind, _, cased), own in kinds.items():
        if len(own) == 1:
            alone.setdefault((kind, cased), []).extend(own)
    groups = [own for own in kinds.values() if len(own) > 1] + [own for own in alone.values() if len(own) > 1]
    rest = [c for own in alone.values() if len(own) == 1 for c in own]
    return {c: "".join(own) for own in [*groups, rest] for c in own}


def _class(c: str) -> str | None:
    own = _classes().get(c)
    return own if own or not c.isalnum() else _others().get(c)


def same_shape(text: str, key: bytes, label: str, allowed=lambda s: True) -> str:
    """Another string of the same shape: digits, vowels and consonants by script and case, the rest as it is.

    A string without letters and digits changes its signs instead.
    """
    radix = [_class(c) for c in text]
    if not any(radix):
        radix = [SIGNS if c in SIGNS else None for c in text]
    size, x = 1, 0
    for c, own in zip(text, radix):
        if own:
            size *= len(own)
            x = x * len(own) + own.index(c)
    if size < 2:
        return text
    shape = "".join(own[0] if own else c for c, own in zip(text, radix))
    cycle, start = Cycle(key, f"{label}|{shape}", size), x
    while True:
        x = y = cycle.next(x)
        out = []
        for c, own in zip(reversed(text), reversed(radix)):
            if own:
                y, digit = divmod(y, len(own))
                out.append(own[digit])
            else:
                out.append(c)
        made = "".join(reversed(out))
        if allowed(made) or x == start:
            return made


# ------------------------------------------------------------------- surrogates by type


def _luhn(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(form: str, characters: str) -> str:
    """The characters in the places of the letters and digits of ``form``."""
    left = iter(characters)
    return "".join(next(left) if c.isalnum() else c for c in form)


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    if _luhn(digits[:-1]) == int(digits[-1]):
        body = digits[0] + same_shape(digits[1:-1], key, f"card{digits[0]}")
        return _refill(text, body + str(_luhn(body)))
    ok = lambda s: _luhn(s[:-1]) != int(s[-1])  # noqa: E731  numbers without a check digit stay so
    return _refill(text, digits[0] + same_shape(digits[1:], key, f"number{digits[0]}", lambda s: ok(digits[0] + s)))


def _iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")

    def right(body: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97

    body = same_shape(plain[4:], key, "iban" + plain[:2])
    check = (right(body) + int(plain[2:4]) - right(plain[4:])) % 100  # a wrong one stays wrong by as much
    return _refill(text, plain[:2] + f"{check:02}" + body)


_PRIVATE = ((10 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (127 << 24, 8), (169 << 24 | 254 << 16, 16))


def _net(value: int) -> tuple[int, int] | None:
    return next(((base, bits) for base, bits in _PRIVATE if value >> (32 - bits) == base >> (32 - bits)), None)


def _ip(text: str, key: bytes) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    net = _net(value)
    if net:
        base, bits = net
        out = base | Cycle(key, f"ip{base}", 1 << (32 - bits)).next(value - base)
    else:
        cycle, out = Cycle(key, "ip", 1 << 32), value
        while True:
            out = cycle.next(out)
            # Ordinary public addresses stay such; the few special ones (0.*, 224.* and up) stay among themselves.
            if not _net(out) and (1 <= out >> 24 < 224) == (1 <= value >> 24 < 224):
                break
    return ".".join(map(str, out.to_bytes(4, "big")))


def _recased(form: str, made: str) -> str:
    """``made`` in the case of ``form``, character by character."""
    return "".join(m.upper() if f.isupper() else m for f, m in zip(form, made))


def _caseless(text: str) -> str:
    """Small letters where case goes there and back, else the text itself."""
    lower = "".join(c.lower() for c in text)  # a letter at a time: a final sigma is a sigma
    return lower if len(lower) == len(text) and _recased(text, lower) == text else text


def _reserved(domain: str) -> bool:
    return bool(re.search(r"(^|\.)example\.(com|org|net)$", domain))


def _email(text: str, key: bytes) -> str:
    lower = _caseless(text)
    local, _, domain = lower.rpartition("@")
    name, dot, top = domain.rpartition(".")
    new = domain if _reserved(domain) else same_shape(name, key, "domain." + top, lambda s: not _reserved(s + dot + top)) + dot + top
    made = same_shape(local, key, "email@" + domain) + "@" + new
    return made if lower is text else _recased(text, made)


def _ipv6(text: str, key: bytes) -> str:
    value = int(ipaddress.IPv6Address(text))
    low = (1 << 112) - 1  # the first group tells what kind of address it is, and stays
    made = str(ipaddress.IPv6Address(value & ~low | Cycle(key, f"ipv6{value >> 112}", 1 << 112).next(value & low)))
    return made.upper() if text.upper() == text and text.lower() != text else made


def _national(text: str) -> tuple[str, str]:
    """The number without and its digits within: country code and trunk zeros stay, the rest is the entity."""
    country = re.match(r"(?:\+|00)[1-9]\d{0,2}(?=[ .(-])|(?:\+|00)[1-9]\d(?=\d)", text)
    head = len(country[0]) if country else 0
    digits = re.sub(r"\D", "", text[head:])
    if not head and len(digits) == 11 and digits[0] == "1":
        return "1", digits[1:]
    core = digits.lstrip("0")
    return re.sub(r"\D", "", text[:head]) + digits[: len(digits) - len(core)], core


def _phone(text: str, key: bytes) -> str:
    head, core = _national(text)
    # A core never begins with a zero, nor one of eleven digits with a one: such would read as another's prefix.
    barred = "01" if len(core) == 11 else "0"
    return _refill(text, head + same_shape(core, key, "phone", lambda s: s[0] not in barred))


def _listed(key: bytes, name: str) -> str:
    names = FIRST_NAMES[_LISTED[_SPELT[name]]]
    made = names[Cycle(key, "first" + "".join(_LISTED[_SPELT[name]]), len(names)).next(names.index(_SPELT[name]))]
    return made.upper() if name.isupper() else made


def _surname(text: str, key: bytes) -> str:
    lower = _caseless(text)
    if lower is text and text.lower() != text:  # letters whose case is not one to one
        return same_shape(text, key, "name", lambda s: s not in _SPELT and s not in _TITLES)
    return _recased(text, same_shape(lower, key, "surname", lambda s: s.capitalize() not in _SPELT and s.capitalize() not in _TITLES))


MAKERS = {"email": _email, "iban": _iban, "ssn": lambda t, k: same_shape(t, k, "ssn"), "card": _card, "ip": _ip, "ipv6": _ipv6, "phone": _phone, "first": lambda t, k: _listed(k, t), "last": _surname}


def canonical(kind: str, text: str) -> str:
    """What all spellings of an entity have in common."""
    if kind == "phone":
        return _national(text)[1]
    if kind in ("iban", "ssn", "card"):
        return re.sub(r"\W", "", text)
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    return text if kind == "ip" else _caseless(text)


#: Kinds that are read as numbers, whatever the script of their digits.
NUMBERS = ("iban", "ssn", "card", "ip", "phone")
_FOREIGN = re.compile(r"[^\D0-9]")


def plain_digits(text: str) -> str:
    """The text with the digits of all scripts as 0 to 9, a character for a character."""
    found = set(_FOREIGN.findall(text)) if not text.isascii() else None
    return text.translate({ord(c): str(unicodedata.decimal(c)) for c in found}) if found else text


def _in_digits_of(form: str, made: str) -> str:
    """``made`` in the digits of the mention: place for place, or those of its first digit where the lengths differ."""
    zeros = [ord(c) - unicodedata.decimal(c) if c.isdecimal() else None for c in form]
    first = next((z for z in zeros if z is not None), ord("0"))
    places = zeros if len(form) == len(made) else [first] * len(made)
    return "".join(chr((first if z is None else z) + int(c)) if "0" <= c <= "9" else c for z, c in zip(places, made))


_DATE = re.compile(r"(?:1\d|20)\d\d([-./ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?!\d)|(?:0?[1-9]|[12]\d|3[01])([-./ ])(?:0?[1-9]|[12]\d|3[01])\2(?:1\d|20)\d\d(?!\d)|(?:1\d|20)\d\d ?[-.] ?(?:1\d|20)\d\d(?![\d-])")


def _matches(pattern: re.Pattern, text: str, a: int, b: int, kind: str) -> Iterator[re.Match]:
    """Matches from left to right; a date or a range of years is no telephone number, and the search goes on behind it."""
    while m := pattern.search(text, a, b):
        a = max(m.end(), m.start() + 1)
        if kind == "phone" and (date := _DATE.match(m[0])):
            a = m.start() + date.end()
        elif kind == "ipv6":
            try:
                ipaddress.IPv6Address(m[0])
                yield m
            except ValueError:
                pass
        else:
            yield m


#: What every match holds, and the characters that it may consist of.
_AROUND = {
    "email": (re.compile("@"), re.compile(r"[\w%+.@-]*"), re.compile(r"[\w%+.@-]")),
    "ipv6": (re.compile(r"(?<=:)[0-9A-Fa-f]{0,4}:"), re.compile(r"[0-9A-Fa-f:]*"), re.compile(r"[0-9A-Fa-f:]")),
    "number": (re.compile(r"\d"), re.compile(r"[A-Z\d .()+-]*"), re.compile(r"[A-Z\d .()+-]")),
}


def _windows(text: str, anchor: re.Pattern, run: re.Pattern, one: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs around each anchor, with two characters more for what looks ahead."""
    at = 0
    while m := anchor.search(text, at):
        a = m.start()
        while a > at and one.match(text, a - 1):
            a -= 1
        at = run.match(text, m.start()).end()
        yield a, at + 2


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities in order, none overlapping another."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray()

    def take(a: int, b: int, kind: str) -> None:
        nonlocal taken
        taken = taken or bytearray(len(text))
        if taken.find(1, a, b) < 0:
            taken[a:b] = bytes([1]) * (b - a)
            found.append((a, b, kind))

    flat = plain_digits(text)
    windows = {kind: list(_windows(flat, *around)) for kind, around in _AROUND.items()}
    for kind, pattern in PATTERNS:
        for m in (m for a, b in windows[kind if kind in _AROUND else "number"] for m in _matches(pattern, flat if kind in NUMBERS else text, a, b, kind)):
            if kind == "phone" and (not 8 <= sum(c.isdigit() for c in m[0]) <= 16 or not _national(m[0])[1]):
                continue
            take(m.start(), m.end(), kind)
    names = _names(text, [a for a, _, kind in found if kind == "email"])
    if names:
        for m in _WORD.finditer(text):
            if m[0] in names:
                take(m.start(), m.end(), names[m[0]])
            elif not m[0].isalpha():  # parts of a word with hyphens or apostrophes
                for part in re.finditer(r"[^-'’]+", m[0]):
                    if part[0] in names:
                        take(m.start() + part.start(), m.start() + part.end(), names[part[0]])
    if not text.isascii() and _EAST.search(text):
        for m in _HAN.finditer(text):
            take(m.start(), m.end(), "last")
    return sorted(found)


def _names(text: str, emails: list[int]) -> dict[str, str]:
    """Words of the text that are names of persons, and whether they are listed first names."""
    words = [(m.start(), m.end(), m[0]) for m in _CAPITAL.finditer(text) if m[0][0].isupper()]
    names: dict[str, str] = {}

    def add(word: str) -> None:
        if word not in _TITLES and word not in NO_NAMES:
            names[word] = "first" if word in _SPELT else "last"

    def next_to(i: int, j: int, after: tuple[str, ...] = (" ",)) -> bool:
        return 0 <= i and j < len(words) and text[words[i][1] : words[j][0]] in after

    chained = 0
    ends = {b: i for i, (_, b, _) in enumerate(words)}
    for a in emails:  # First Last <address>
        i = ends.get(len(text[max(0, a - 3) : a].rstrip(" <(")) + max(0, a - 3))
        if i is not None and next_to(i - 1, i):
            add(words[i][2])
            add(words[i - 1][2])
    for i, (a, b, word) in enumerate(words):
        if word in _SPELT:
            add(word)
            if next_to(i, i + 1) and len(words[i + 1][2]) > 1:
                add(words[i + 1][2])
        elif word in _TITLES:
            j = i
            while next_to(j, j + 1, (" ", ". ") if j == i else (" ",)) and words[j + 1][2] not in NO_NAMES | _TITLES and len(words[j + 1][2]) > 1:
                j += 1
                add(words[j][2])
        else:
            if (word in SURNAMES or word.capitalize() in SURNAMES) and next_to(i - 1, i) and words[i - 1][2] not in NO_NAMES | _TITLES and len(words[i - 1][2]) > 1:
                add(word)
                add(words[i - 1][2])
            if text.startswith(SAID, b) and next_to(i - 1, i) and len(words[i - 1][2]) > 1:
                add(word)
                add(words[i - 1][2])
            if word not in NO_NAMES and len(word) > 1 and _cued(text[max(0, a - 28) : a]):
                add(word)
                j = i
                while i >= chained and next_to(j, j + 1) and words[j + 1][2] not in NO_NAMES | _TITLES and len(words[j + 1][2]) > 1:
                    j += 1
                    add(words[j][2])
                chained = max(chained, j)
    return names


def _cued(before: str) -> bool:
    before = before.rstrip(" \n").lower()
    if before.endswith("name:"):  # of a form; not that of a file or a host
        return not before.endswith(("username:", "filename:", "hostname:", "file name:", "host name:", "domain name:", "brand name:", "user name:"))
    return (before := before.rstrip(",:")).endswith(CUES) and not before.endswith("endear")


@lru_cache(maxsize=1 << 16)
def surrogate(kind: str, text: str, key: bytes) -> str:
    return MAKERS[kind](text, key)


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    out, at, rows = [], 0, []
    for start, end, kind in detect(text):
        old = text[start:end]
        read = plain_digits(old) if kind in NUMBERS else old
        made = surrogate(kind, read, key)
        new = made if read == old else _in_digits_of(old, made)
        out += [text[at:start], new]
        rows.append({"type": kind, "start": start, "end": end, "original": old, "surrogate": new, "entity": canonical(kind, read), "stands": canonical(kind, made)})
        at = end
    return "".join([*out, text[at:]]), rows


_ENTITY = StructType([StructField("type", StringType()), *(StructField(c, IntegerType()) for c in ("start", "end")), *(StructField(c, StringType()) for c in ("original", "surrogate", "entity", "stands"))])
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), *((c, pa.string()) for c in ("original", "surrogate", "entity", "stands"))]))


def pseudonymize(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, the text with surrogates, and its entities (code points, end exclusive).

    Whoever holds the key can tell surrogates from originals; the entities are for audits and are not to be kept.
    """

    def compute(column: pa.Array) -> list[pa.Array]:
        made = [replace(t, key) if t is not None else (None, []) for t in column.to_pylist()]
        return [pa.array([t for t, _ in made], pa.string()), pa.array([e for _, e in made], _ARROW)]

    fields = [StructField("replaced", StringType()), StructField("entities", ArrayType(_ENTITY))]
    return map_text(narrow(df, id_col, text_col), ["doc_id"], "text", compute, fields).withColumnRenamed("replaced", "text")


def collisions(replaced: DataFrame) -> DataFrame:
    """(type, value, fault): surrogates that stand for several entities, entities that have several or are their own; none is right."""
    pairs = cut(replaced.select(F.explode("entities").alias("e")).select("e.type", "e.entity", "e.stands").distinct())
    shared = pairs.groupBy("type", F.col("stands").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("type", "value", F.lit("shared").alias("fault"))
    split = pairs.groupBy("type", F.col("entity").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("type", "value", F.lit("split").alias("fault"))
    same = pairs.where("entity = stands").select("type", F.col("entity").alias("value"), F.lit("unchanged").alias("fault"))
    return shared.unionByName(split).unionByName(same)


def checked(replaced: DataFrame) -> DataFrame:
    """``replaced``, if no two entities share a surrogate and no entity has two; an error that tells the faults otherwise."""
    faults = cut(collisions(replaced))
    if not faults.isEmpty():
        raise ValueError(f"surrogates collide: {[tuple(r) for r in faults.groupBy('type', 'fault').count().collect()]}")
    return replaced
