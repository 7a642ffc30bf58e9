"""Surrogates for personal data: keyed, of the same type and format, distinct for distinct originals, equal for equal ones.

Each unit of an entity (a number, key, address, mail address, or one part of a name) has a canonical form: digits without
their grouping, lower-cased letters. It is replaced by a keyed permutation of all canonical forms of its kind and size (a
Feistel network s with cycle walking over the mixed-radix number that the characters spell, used as s^-1(s(x) + k), which
leaves nothing in its place), then written in the original's grouping and case. A bijection: two units never meet in one
surrogate, and a unit gets the same one in every document and format, without a table. Cards and account numbers that
pass their check still do, addresses stay in their network class, phones keep their country.

A part of a name is permuted among the strings of its script and length, and the result is written as syllables of that
script, enough of them that no two numbers read alike, with an ending of the title's gender for first names and of a
family name's own form (Иванова stays feminine, and of one family with Иванов). So Mr. John Smith, Mr. Smith and, in the
same text, John Smith agree; the names to choose from grow with the length of those replaced and can't run out.

A check over the distinct units of the whole corpus groups them by surrogate; were two to meet (or one to be its own
surrogate) the later ones would be rekeyed by a counter that lengthens names, until none do.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import delete_stored, fresh, schema_plus, stored

#: The key's setting in the session, and the key without it, which is no secret.
KEY_SETTING = "spark.siltbed.pii.key"
KEY = b"replace this key in production"
#: Most bytes of rekeyed units that are broadcast, and what one takes in a dict besides its text; more are joined.
REKEYED_BYTES = 32 << 20
ENTRY_BYTES = 250

_PHONES = (
    # international: a plus and 7 to 15 digits, grouped anyhow or not at all; a decimal number with a sign is none
    r"(?<![\w+])\+(?!\d+\.\d+(?![\d.()-]| \d))[1-9](?:[ .()-]{0,2}\d){6,14}(?!\d)",
    # ten digits: 3, 3 and 4, the last two together or not
    r"(?<!\w)\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    r"(?<![\w.+-])\d{3}[ .-]\d{3} ?\d{4}(?![\w-])",
    # a trunk zero: area code and one long number, area code and two groups, or pairs
    r"(?<![\w.,+/-])(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])\d{5,8}(?![\w/-])",
    r"(?<![\w.,+/-])(?:\(0\d{2,4}\) ?|0\d{2,4} )\d{3,4} \d{3,4}(?![\w/-])",
    r"(?<![\w.,+/-])0\d(?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?![\w/-])",
    # digits without any separator, behind a word that tells what they are
    r"(?:(?<=[Cc]all )|(?<=[Tt]el )|(?<=[Tt]el: )|(?<=[Tt]el\. )|(?<=[Pp]hone )|(?<=[Pp]hone: )|(?<=[Mm]obile )|(?<=[Mm]obile: )|(?<=[Ff]ax )|(?<=[Ff]ax: ))\d{7,12}(?![\w-])",
)
_TITLE = r"Mr\.?|Mrs\.?|Ms\.?|Miss|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme\.?|Señor|Señora|Sr\.|Sra\.|Dr\.|господин|госпожа"
_PART = r"[^\W\d_a-zа-яёß-ÿ](?:[^\W\d_]|[-'’](?=[^\W\d_])){1,30}"
_INITIAL = r"[^\W\d_a-zа-яёß-ÿ]\."
_PATTERNS = (
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("secret", r"(?:(?<=password=)|(?<=passwd=)|(?<=secret=)|(?<=api_key=)|(?<=token=)|(?<=token = \")|(?<=token: \")|(?<=secret = \")|(?<=api_key = \")|(?<=password = \"))(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{8,}"),
    ("aws_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?<![Vv]ersion )(?<![Rr]elease )(?<![Ss]ection )(?<![Vv]er )(?<![Vv]er\. )(?<![A-Za-z])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}:(?![\w:])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", "|".join(_PHONES)),
    ("card", r"(?<![\w.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])"),
    ("name", rf"(?<!\w)(?:{_TITLE})(?: (?:{_INITIAL} ){{0,3}}{_PART}){{1,3}}"),
)
ENTITY = re.compile("|".join(f"(?P<{t}>{p})" for t, p in _PATTERNS if t != "name"))
NAME = re.compile(dict(_PATTERNS)["name"])
#: Every entity but a name holds one of these or follows one on its line, and begins and ends near it.
SIGN = re.compile(r"[0-9@=\"]+|A[KS]IA")
BEFORE, AFTER = 80, 400
#: What follows a stretch's end within the same token; tokens have no greatest length.
REST = re.compile(r"[A-Za-z0-9+/_.@-]*")
#: Characters that are permuted at once; a longer text's next ones are keyed by those before them too.
CHUNK = 1024
FEMALE = frozenset({"Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"})
MALE = frozenset({"Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"})
TITLES = tuple(sorted(FEMALE | MALE | {"Dr"}))
#: Country codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = frozenset("17"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: First digits of issuers of payment cards, with the numbers' lengths.
ISSUERS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}|6(?:011|4[4-9]\d|5\d\d)\d{12}|62\d{14,17}")
#: Address classes that surrogates stay in; the loopback and the unspecified address tell nobody.
NETWORKS = tuple(ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10"))
NOBODY = tuple(ipaddress.ip_network(n) for n in ("127.0.0.0/8", "0.0.0.0/8", "255.255.255.255/32"))
#: Letters of parts of names, plain Latin, Latin and Cyrillic, and the consonants and vowels that surrogates are spelled with.
_PLAIN = "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = _PLAIN + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœšžčćđłńśźżąęěňřťůőűğış"
_RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ"
_SPELLED = {_PLAIN: ("bdfgklmnprstv", "aeiou"), _ACCENTED: ("bdfgklmnprstv", "aeiou"), _RUSSIAN: ("бвгдзклмнпрст", "аеиоу")}
_MARKED = dict(zip("aeiou", "áéíóú"))
#: Endings of first names by the title's gender, and of family names; feminine forms of family names and what they stand for.
_FIRST = {False: {"f": "a", "m": "o", "n": "e"}, True: {"f": "а", "m": "й", "n": "ко"}}
_LAST = {False: ("n", "n"), True: ("в", "ва")}
_FEMININE = re.compile("(?<=[оеё]в)а$|(?<=[иы]н)а$|(?<=[сц]к)ая$")


@lru_cache(1 << 16)
def _mac(key: bytes, what: str) -> int:
    return int.from_bytes(hmac.new(key, what.encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def _walked(x: int, size: int, half: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: eight Feistel rounds over 2 * half bits, walked until inside."""
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in reversed(range(8)) if back else range(8):
            if back:
                a, b = b ^ _round(key, f"{tweak}|{half}|{r}|{a}", mask), a
            else:
                a, b = b, a ^ _round(key, f"{tweak}|{half}|{r}|{b}", mask)
        x = a << half | b
        if x < size:
            return x


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) that leaves no number in its place (but the one of a range of one)."""
    if size < 2:
        return x
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    step = 1 + _mac(key, f"{tweak}|step") % (size - 1)
    return _walked((_walked(x, size, half, key, tweak) + step) % size, size, half, key, tweak, back=True)


def _round(key: bytes, what: str, mask: int) -> int:
    value, n = _mac(key, what), 1
    while mask >> (256 * n):
        value |= _mac(key, f"{what}|{n}") << (256 * n)
        n += 1
    return value & mask


_CLASSES = tuple((frozenset(c), c) for c in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_HEX = tuple((frozenset(c), c) for c in ("0123456789abcdef", "0123456789ABCDEF"))


def same_format(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """text with its ASCII digits and letters replaced by others of their kind; a bijection on texts of one format."""
    kinds = _CLASSES
    if hexadecimal:
        kinds = next(((k,) for k in _HEX if all(c in k[0] for c in text)), _CLASSES)
    if len(text) > CHUNK:
        cuts = range(0, len(text), CHUNK)
        return "".join(_permuted_text(text[k : k + CHUNK], kinds, key, f"{tweak}|{len(text)}|{_mac(key, text[:k])}" if k else tweak) for k in cuts)
    return _permuted_text(text, kinds, key, tweak)


def _permuted_text(text: str, kinds: tuple[tuple[frozenset[str], str], ...], key: bytes, tweak: str) -> str:
    slots = [(i, next((a for s, a in kinds if c in s), None)) for i, c in enumerate(text)]
    slots = [(i, a) for i, a in slots if a]
    x, size = 0, 1
    for i, a in slots:
        x, size = x * len(a) + a.index(text[i]), size * len(a)
    x = permuted(x, size, key, f"{tweak}|{''.join(a[0] for _, a in slots)}|{len(text)}")
    out = list(text)
    for i, a in reversed(slots):
        x, r = divmod(x, len(a))
        out[i] = a[r]
    return "".join(out)


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def _refilled(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _valid_account(text: str) -> bool:
    """Whether an account number without spaces passes its check: modulo 97, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def country_code(digits: str) -> str:
    return digits[:1] if digits[0] in ONE_DIGIT else digits[:2] if digits[:2] in TWO_DIGITS else digits[:3]


def lemma(part: str) -> tuple[str, bool]:
    """A family name's ground form, and whether the part is its feminine form."""
    m = _FEMININE.search(part)
    return (part[: m.start()] + ("ий" if m[0] == "ая" else ""), True) if m else (part, False)


def name_parts(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The title, and the parts of a name in order: (role, text, unit). Roles are first, last, initial and, for hyphens,
    apostrophes and spaces between parts, mark, which have no unit."""
    title, _, rest = text.partition(" ")
    words = rest.split(" ")
    out: list[tuple[str, str, str]] = []
    for k, word in enumerate(words):
        out += [("mark", " ", "")] if k else []
        if word.endswith("."):
            out.append(("initial", word, ""))
            continue
        role = "last" if k + 1 == len(words) else "first"
        for x in re.split("([-'’])", word):
            if x in ("-", "'", "’"):
                out.append(("mark", x, ""))
            elif x:
                out.append((role, x, lemma(x.lower())[0] if role == "last" else x.lower()))
    return title, out


def units(kind: str, text: str) -> list[tuple[str, str]]:
    """(kind, canonical form) of what has a surrogate of its own in an entity."""
    if kind == "name":
        return [(kind, unit) for *_, unit in name_parts(text)[1] if unit]
    if kind == "email":
        return [(kind, text.lower())]
    if kind in ("phone", "card", "ssn"):
        return [(kind, "+" * (text[0] == "+") + re.sub(r"\D", "", text))]
    if kind == "iban":
        return [(kind, text.replace(" ", ""))]
    if kind == "ip6":
        return [(kind, str(ipaddress.IPv6Address(text)))]
    return [(kind, text)]


def unit_surrogate(kind: str, unit: str, key: bytes = KEY, again: int = 0) -> str:
    """The replacement of a canonical form; again counts the times that it was rekeyed."""
    tweak = kind if not again else f"{kind}#{again}"
    if kind == "name":
        return _stem(unit, key, tweak, again)
    if kind == "email":
        local, _, domain = unit.partition("@")
        *labels, top = domain.split(".")
        return same_format(local, key, tweak) + "@" + ".".join([*(same_format(x, key, f"{tweak}|domain") for x in labels), top])
    if kind == "ip":
        at = ipaddress.IPv4Address(unit)
        home = next((n for n in NETWORKS if at in n), None)
        if home:
            first, size = int(home.network_address), home.num_addresses
            return str(ipaddress.IPv4Address(first + permuted(int(at) - first, size, key, f"{tweak}|{home}")))
        while True:
            at = ipaddress.IPv4Address(permuted(int(at), 1 << 32, key, tweak))
            if not any(at in n for n in (*NETWORKS, *NOBODY)):
                return str(at)
    if kind == "ip6":
        x = int(ipaddress.IPv6Address(unit))
        return str(ipaddress.IPv6Address((x >> 112 << 112) | permuted(x & ((1 << 112) - 1), 1 << 112, key, f"{tweak}|{x >> 112}")))
    if kind == "aws_key":
        return unit[:4] + same_format(unit[4:], key, tweak)
    if kind == "secret":
        return same_format(unit, key, tweak, hexadecimal=True)
    if kind == "iban":
        valid = _valid_account(unit)
        while True:
            if valid:
                rest = same_format(unit[4:], key, f"{tweak}|valid|{unit[:2]}")
                return unit[:2] + next(c for c in (f"{n:02}" for n in range(2, 99)) if _valid_account(unit[:2] + c + rest)) + rest
            unit = unit[:2] + same_format(unit[2:], key, f"{tweak}|{unit[:2]}")
            if not _valid_account(unit):
                return unit
    if kind == "card":  # all cards pass the check
        body = same_format(unit[1:-1], key, f"{tweak}|{unit[0]}")
        return unit[0] + body + next(c for c in "0123456789" if luhn(unit[0] + body + c))
    if kind == "phone":
        head = "+" + country_code(unit[1:]) if unit[0] == "+" else unit[: len(unit) - len(unit.lstrip("0"))]
        rest = unit[len(head) :]
        while True:
            rest = same_format(rest, key, f"{tweak}|{head}")
            if unit[0] == "+" or rest[:1] != "0":
                return head + rest
    return same_format(unit, key, tweak)


def surrogate(kind: str, text: str, key: bytes = KEY, again: Callable[[str, str], int] = lambda kind, unit: 0, make: Callable[..., str] = unit_surrogate) -> str:
    """The replacement of an entity in its own grouping and case; again tells how often a unit was rekeyed."""
    if kind == "name":
        return _name(text, key, again, make)
    [(_, unit)] = units(kind, text)
    made = make(kind, unit, key, again(kind, unit))
    if kind == "email":
        return _cased(made, text)
    if kind in ("phone", "card", "ssn"):
        return _refilled(text, made.lstrip("+"))
    if kind == "iban":
        it = iter(made)
        return "".join(c if c == " " else next(it) for c in text)
    return made


def _cased(made: str, like: str) -> str:
    """Mail addresses in another case are the same address, spelled in its case."""
    return "".join(m.upper() if c.isupper() else m for m, c in zip(made, like))


def _name(text: str, key: bytes, again: Callable[[str, str], int], make: Callable[..., str]) -> str:
    title, parts = name_parts(text)
    bare = title.rstrip(".")
    gender = "f" if bare in FEMALE else "m" if bare in MALE else "n"
    out = [title, " "]
    for role, part, unit in parts:
        if role == "mark":
            out.append(part)
        elif role == "initial":
            out.append(same_format(part, key, "initial") if part[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else _same_letters(part, key))
        else:
            made = make("name", unit, key, again("name", unit))
            cyrillic = any("\u0400" <= c <= "\u04ff" for c in made)
            made += _FIRST[cyrillic][gender] if role == "first" else _LAST[cyrillic][lemma(part.lower())[1]]
            out.append(made.upper() if len(part) > 1 and part.isupper() else made[0].upper() + made[1:])
    return "".join(out)


def _stem(unit: str, key: bytes, tweak: str, again: int) -> str:
    """Syllables for a lower-cased part of a name, two letters each and one more syllable for each rekeying."""
    letters = next((x for x in (_PLAIN, _ACCENTED, _RUSSIAN) if set(unit) <= set(x)), None)
    if letters is None:
        return _same_letters(unit, key, tweak)
    base, x = len(letters), 0
    for c in unit:
        x = x * base + letters.index(c)
    # strings of a length are permuted; shorter ones come before longer ones, so that all numbers of an alphabet differ
    x = permuted(x, base ** len(unit), key, f"{tweak}|{base}|{len(unit)}") + sum(base**n for n in range(1, len(unit)))
    consonants, vowels = _SPELLED[letters]
    radix, made = len(consonants) * len(vowels), []
    most = sum(base**n for n in range(1, len(unit) + 1))
    x, most = x * radix**again + _mac(key, f"{tweak}|{unit}") % radix**again, most * radix**again
    while most > 1 or not made:
        x, r = divmod(x, radix)
        most = -(-most // radix)
        made.append(consonants[r // len(vowels)] + vowels[r % len(vowels)])
    out = "".join(reversed(made))
    return out[0] + _MARKED[out[1]] + out[2:] if letters is _ACCENTED else out


@lru_cache(256)
def _block_letters(block: int) -> str:
    """The letters of 128 code points, lower-cased ones only where there are cases."""
    every = [c for c in map(chr, range(block << 7, (block + 1) << 7)) if c.isalpha()]
    return "".join([c for c in every if c.islower() and len(c.upper()) == 1] or every)


def _same_letters(text: str, key: bytes, tweak: str = "letters") -> str:
    """text with each letter of any script replaced by one of its block; a bijection on texts of one form."""
    x, size, sets = 0, 1, []
    for c in text:
        letters = _block_letters(ord(c) >> 7)
        at = letters.find(c.lower() if len(c.lower()) == 1 else c)
        sets.append(letters if at >= 0 else "")
        if at >= 0:
            x, size = x * len(letters) + at, size * len(letters)
    x = permuted(x, size, key, f"{tweak}|{'|'.join(s[:1] for s in sets)}")
    out = []
    for c, letters in zip(reversed(text), reversed(sets)):
        if letters:
            x, r = divmod(x, len(letters))
            c = letters[r].upper() if c.isupper() else letters[r]
        out.append(c)
    return "".join(reversed(out))


def _meant(kind: str, text: str) -> bool:
    """Whether what a pattern found is an entity: a card of an issuer that passes its check, an address that is one of somebody."""
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return bool(ISSUERS.fullmatch(digits)) and luhn(digits)
    if kind == "ip":
        at = ipaddress.IPv4Address(text)
        return not any(at in n for n in NOBODY)
    if kind == "ip6":
        try:
            return int(ipaddress.IPv6Address(text)) > 1
        except ValueError:
            return False
    return True


def entities(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(from, to, type) of the entities of a whole text, from left to right."""
    if not text:
        return
    found = [(m.start(), m.end(), m.lastgroup) for a, b in _near_signs(text) for m in ENTITY.finditer(text, a, b)]
    if any(t in text for t in TITLES):
        found = sorted([*found, *((m.start(), m.end(), "name") for m in NAME.finditer(text))])
    at = 0
    for a, b, kind in found:
        if a >= at and _meant(kind, text[a:b]):
            yield a, b, kind
            at = b


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(from, to, type, entity) of the entities, and of full names that stand without their title elsewhere in the text; the
    entity of those is the name with its first title."""
    found = [(a, b, kind, text[a:b]) for a, b, kind in entities(text)]
    full: dict[str, str] = {}
    for *_, kind, entity in found:
        bare = entity.partition(" ")[2]
        if kind == "name" and " " in bare:
            full.setdefault(bare, entity)
    if not full:
        return found
    taken = [(a, b) for a, b, *_ in found]
    longest = sorted(full, key=len, reverse=True)
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, longest))})(?!\w)", text):
        k = bisect.bisect_left(taken, (m.end(), -1))
        if not k or taken[k - 1][1] <= m.start():
            found.append((m.start(), m.end(), "name", full[m[0]]))
    return sorted(found)


def _near_signs(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of lines around signs; signs are told far faster than the patterns run."""
    a = b = -1
    for m in SIGN.finditer(text):
        p, q = m.span()
        cut = text.rfind("\n", max(0, p - BEFORE), p)
        low = cut + 1 if cut >= 0 else max(0, p - BEFORE)
        cut = text.find("\n", q, q + AFTER)
        high = cut if cut >= 0 else min(len(text), q + AFTER)
        if high <= b:
            continue
        high = REST.match(text, high).end()
        if low <= b:
            b = high
        else:
            if b >= 0:
                yield a, b
            a, b = low, high
    if b >= 0:
        yield a, b


def originals(docs: DataFrame) -> DataFrame:
    """The distinct (type, original) of the units of docs' texts, in canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({u for t in batch.column(0).to_pylist() for a, b, kind in entities(t) for u in units(kind, t[a:b])})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["type", "original"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "type string, original string").distinct()


def rekeyings(found: DataFrame, key: bytes = KEY, make: Callable[..., str] = unit_surrogate) -> DataFrame:
    """(type, original, again) of the units that must be rekeyed so that no two of a type share a surrogate and none is its own.

    found holds distinct (type, original). Each round groups all of them by surrogate; the first by code points keeps its
    surrogate, the others go up by one. Ends when a round finds nobody, which for bijections is the first; the states are
    tables, nothing comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts, again, old = (c.to_pylist() for c in batch.columns)
            made = [o if o is not None else make(k, t, key, n) for k, t, n, o in zip(kinds, texts, again, old)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["type", "original", "again", "made"])

    def state(rows: DataFrame) -> DataFrame:
        return stored(rows.mapInArrow(run, "type string, original string, again int, made string"), "surrogates")

    now = state(found.select("type", "original", F.lit(0).alias("again"), F.lit(None).cast("string").alias("made")))
    while True:
        first = now.groupBy("type", "made").agg(F.min("original").alias("first"), F.count("*").alias("n"))
        met = now.join(first.where("n > 1"), ["type", "made"]).where("original <> first").select("type", "original")
        met = stored(met.union(now.where("original = made").select("type", "original")).distinct(), "rekeyed")
        if not met.take(1):
            return now.where("again > 0").select("type", "original", "again")
        more = now.join(met.withColumn("more", F.lit(1)), ["type", "original"], "left")
        after = state(more.select("type", "original", (F.col("again") + F.coalesce("more", F.lit(0))).alias("again"), F.when(F.col("more").isNull(), F.col("made")).alias("made")))
        for old in (now, met):
            delete_stored(old)
        now = after


def rekeyed(found: DataFrame, key: bytes = KEY, make: Callable[..., str] = unit_surrogate) -> dict[tuple[str, str], int]:
    """rekeyings() as a dict."""
    return {(r["type"], r["original"]): r["again"] for r in rekeyings(found, key, make).collect()}


def replaced(text: str | None, make: Callable[[str, str], str]) -> tuple[str | None, list[str]]:
    """text with its entities replaced, and their types."""
    found = mentions(text)
    if not found:
        return text, []
    out, at = [], 0
    for a, b, kind, entity in found:
        made = make(kind, entity)
        out += [text[at:a], made if b - a == len(entity) else made.partition(" ")[2]]
        at = b
    return "".join([*out, text[at:]]), [kind for _, _, kind, _ in found]


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, else KEY."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else KEY


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with text replaced, and n_entities and entity_types (sorted, distinct); key: default session_key().

    A null text stays null and an empty one empty, with no entities; very long texts are read whole; every row gives one
    row; equal originals get equal surrogates in all rows; other columns stay, and the new ones get a leading _ where names
    clash. Names are found behind a title only, and where a text repeats such a full name without it.
    """
    key = session_key(docs.sparkSession) if key is None else key
    n, kinds = fresh(docs, "n_entities"), fresh(docs, "entity_types")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    times = rekeyings(stored(originals(docs), "originals"), key)
    names = docs.columns
    at, schema = names.index("text"), schema_plus(docs, {n: "long", kinds: "array<string>"})
    few = times.agg(F.coalesce(F.sum(F.octet_length("original") + ENTRY_BYTES), F.lit(0))).first()[0] <= REKEYED_BYTES
    shared = docs.sparkSession.sparkContext.broadcast({(r["type"], r["original"]): r["again"] for r in times.collect()} if few else {})
    if not few:
        docs = _with_rekeyings(docs, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lru_cache(1 << 16)(unit_surrogate)
        for batch in batches:
            columns = batch.columns[: len(names)]
            own = [{(x["type"], x["original"]): x["again"] for x in r or ()} for r in batch.column(len(names)).to_pylist()] if not few else [shared.value] * batch.num_rows
            got = [replaced(t, lambda kind, text, o=o: surrogate(kind, text, key, lambda k, u: o.get((k, u), 0), unit)) for t, o in zip(columns[at].to_pylist(), own)]
            columns[at] = pa.array([g[0] for g in got], pa.string())
            new = [pa.array([len(g[1]) for g in got], pa.int64()), pa.array([sorted(set(g[1])) for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=[*names, n, kinds])

    return docs.mapInArrow(run, schema)


def _with_rekeyings(docs: DataFrame, times: DataFrame) -> DataFrame:
    """docs with the rekeyings of each text's own units in a last column, joined by a digest of the text."""
    digest, own, held_digest = fresh(docs, "digest"), fresh(docs, "rekeyings"), fresh(docs, "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(d, *u) for d, t in zip(*(c.to_pylist() for c in batch.columns)) for a, b, kind in entities(t) for u in units(kind, t[a:b])})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], ["d", "type", "original"])

    held = docs.select(F.sha2("text", 256), "text").mapInArrow(run, "d string, type string, original string").distinct()
    held = held.join(times, ["type", "original"]).groupBy(F.col("d").alias(held_digest)).agg(F.collect_list(F.struct("type", "original", "again")).alias(own))
    rows = docs.withColumn(digest, F.sha2("text", 256))
    return rows.join(held, F.col(digest) == F.col(held_digest), "left").select(*docs.columns, own)
