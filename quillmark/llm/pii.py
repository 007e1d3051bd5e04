"""Surrogates for personal data.

Detected kinds: e-mail addresses, IPv4 and IPv6 addresses, payment cards and IBANs (with right check
digits and an issuer's prefix; other long numbers are none), national numbers in the nnn-nn-nnnn
form, phone numbers (international, in North American forms, and in the national forms of France and
Germany, which begin with 0), secrets (``token = "..."`` and the like), titled names (``Mr``, ``Frau``, ``Mme``
and so on, which tell the gender; in capitals too, and after ``mr`` and ``mrs``), and the words of a titled
name wherever else they stand in the same document with a capital, but for names of months and weekdays.  Every entity is replaced by a keyed surrogate of its own type and format: a digit
by a digit, a hex digit by one of its case, a letter by a letter of its script and case, a given
name by a name with its gender's ending, a card keeps its check digit right, an address gets a
reserved ending.

Digits and letters are replaced by a keyed permutation (a balanced Feistel network of HMAC rounds
over the entity's alphabet positions), so different entities of one format get different
surrogates, and one entity gets the same everywhere: distinctness and coreference need no table.
What is one entity in several spellings (case of mailboxes and secrets, spacing of phone numbers,
cards and IBANs, forms of IPv6) is permuted in one normal form.  A name's entities are its words, each
by its role: a family name is one whoever bears it, and in whatever case; so is a given name, whose
permuted letters are followed by the ending of its gender.  Names keep vowels and consonants in
their places.  In each document surrogates are checked against all entities there and against
each other; one that meets another's is permuted again until it is free, and a name too short for
that grows.

The key comes from the Spark setting ``spark.quillmark.pii.secret``.  Without it a random key is made
for the session and kept in that setting, so nobody can invert the output, and another session's
surrogates are others.

Defined cases: a null text stays null; a text without entities comes back unchanged; overlapping
finds go to the leftmost, then the first kind listed; the gender of a given name is what a title in
the document tells, or ``n``; equal rows get equal texts; other columns of ``documents`` pass through;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import modest, table

KEY_SETTING = "spark.quillmark.pii.secret"
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "secret", "name")
_GROUPS = (*KINDS, "ip6")
DIGITS, HEX, UPPER, LOWER = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Titles by gender: m, f or n (either).
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n"}
#: Endings that tell a given name's gender, for Latin, Greek and Cyrillic letters.
ENDINGS = {"f": "aα\u0430", "m": "oο\u043e", "n": "eε\u0435"}
#: Country codes of one and two digits; all others have three.
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ISSUER = re.compile(r"4|5[0-9]|6[0-9]|3[04-9]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
_SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ")



def _letters(*categories: str) -> str:
    """The inside of a character class: ranges of the code points of Unicode categories."""
    out, last = [], -2
    for c in range(0x80, 0x32400):
        if unicodedata.category(chr(c)) in categories:
            if c == last + 1:
                out[-1][1] = c
            else:
                out.append([c, c])
            last = c
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


# Names: words that begin with a capital (inner capitals, hyphens and apostrophes too), initials and
# particles, any number of them; where letters have no case nothing tells the end, so up to three words.
_TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ")"
#: Titles that count in capitals, before words in capitals, and those that count in small letters.
_LOUD, _LOW = "(?:MR|MRS|MISS|DR|PROF|HERR|HERRN|FRAU|MME|MONSIEUR|MADAME|SEÑOR|SEÑORA)", "(?:mr|mrs)"
_BY_TITLE = {t.casefold(): g for t, g in TITLES.items()}
#: Names of months and weekdays are no one's name where they stand alone. Fixed values.
_CALENDAR = frozenset(
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
    " januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag"
    " janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche"
    " enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo".split()
)
_UP, _UNCASED = f"[A-Z{_letters('Lu', 'Lt')}]", f"[{_letters('Lo')}]"
_LETTER = rf"(?:[^\W\d_]|[{_letters('Mn', 'Mc')}])"
_JOIN = r"(?!['’]s(?!\w))['’‐‑-]"
_PARTICLE = r"(?:(?:von|vom|van|der|den|de|del|della|di|da|dos|das|do|du|la|le|zu|zum|zur|bin|ibn|ter|ten|af|av|d['’](?=[A-ZÀ-Þ]))(?:[ ]|(?<=['’])))"
_INITIAL = rf"{_UP}\.(?:-?{_UP}\.)*"
_WORD = rf"(?!{_TITLE}(?!\w))(?:{_INITIAL}|{_UP}(?:{_LETTER}+(?:{_JOIN}{_LETTER}+)*|(?:{_JOIN}{_LETTER}+)+)|{_UP}(?=[ ]{_UP}))"
_UNCASED_WORD = rf"{_UNCASED}{_LETTER}*(?:['’‐‑·-]{_LETTER}+)*"
_NAME = rf"(?:{_PARTICLE}*{_WORD}(?:(?:[ ]|(?<=\.)){_PARTICLE}*{_WORD})*|{_UNCASED_WORD}(?:[ ]{_UNCASED_WORD}){{0,2}})"
_TITLED = rf"(?<!\w)(?P<title>{_TITLE}(?:(?:\.[ ]?|[ ]){_TITLE}(?!\w))*)(?:\.?[ ]?(?:med|phil|rer|nat|jur|iur|ing|habil|pol|oec|theol|dent|vet|h\.[ ]?c)\.)*(?:\.[ ]?|[ ])(?P<nv>{_NAME})"
_CAPITALS = rf"{_UP}(?:(?:{_JOIN})?{_UP})+"
_LOUD_TITLED = rf"(?<!\w)(?P<loud>{_LOUD}(?:(?:\.[ ]?|[ ]){_LOUD}(?!\w))*)(?:\.[ ]?|[ ])(?P<uv>(?!{_LOUD}(?!\w)){_CAPITALS}(?:[ ]{_CAPITALS})?)(?!\w)"
_LOW_TITLED = rf"(?<!\w)(?P<low>{_LOW})\.?[ ](?P<lv>(?!(?:and|the|with)(?!\w))[^\W\d_]{{3,}}(?:{_JOIN}[^\W\d_]+)*)"

_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+%-])[\w.+%-]{1,64}@[^\W_](?:[\w-]{0,62}\.)+[^\W\d_]{2,24}(?![\w-]))
|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
|(?P<card>(?<![\w.-])\d{4}(?P<cs>[ -]?)\d{4}(?P=cs)\d{4}(?P=cs)\d{1,7}(?![\w-])|(?<![\w.-])3[47]\d{2}(?P<as>[ -]?)\d{6}(?P=as)\d{5}(?![\w-]))
|(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))
|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]{0,34}::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{6,39}(?![\w:]))
|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[.-]?\d{2,4}|[ ](?!(?:\d{1,3}\.){3}\d{1,3}(?![\w.]))\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0[1-9](?:(?P<ps>[ .-])\d{2})(?:(?P=ps)\d{2}){3}|0[1-9]\d{1,3}[ /-]\d{5,8})(?![\w]|[.-]\d))
|(?P<secret>(?<!\w)(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth|bearer)\s*[=:]\s*["']?(?P<sv>[A-Za-z0-9_\-/+]{8,})|(?<!\w)(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?(?P<sw>[A-Za-z0-9_-]{16,}))
|(?P<name>"""
    + "|".join((_LOUD_TITLED, _TITLED, _LOW_TITLED))
    + ")",
    re.X,
)
#: What every find holds, from the same parts as the pattern.
_MAY = re.compile(rf"[@0-9]|::|(?i:token|secret|passw|key|auth|bearer)|(?<!\w)(?:(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?[A-Za-z0-9_-]{{16}}|(?:{_TITLE}|{_LOUD}|{_LOW})[. ])")


_RANGES = ((0x3B1, 0x3C9), (0x391, 0x3A9), (0x430, 0x44F), (0x410, 0x42F), (0x4E00, 0x9FFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x5D0, 0x5EA), (0x627, 0x64A))
_NEAR = "àâäçèéêëîïñôöùûüÀÂÄÇÈÉÊËÎÏÑÔÖÙÛÜ"


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str | None:
    """The letters or digits that may stand for a sign; None if the sign stays."""
    for a in (DIGITS, LOWER, UPPER):
        if c in a:
            return a
    code = ord(c)
    for low, high in _RANGES:
        if low <= code <= high and chr(code).isalpha():
            return "".join(chr(x) for x in range(low, high + 1) if chr(x).isalpha())
    if c.isalpha():
        near = _NEAR[:16] if c.islower() else _NEAR[16:]
        if c in near:
            return near
        low = code & ~0x7F
        same = "".join(x for x in map(chr, range(low, low + 128)) if _sort(x) == _sort(c) and x not in _NEAR and not any(a <= ord(x) <= b for a, b in _RANGES))
        return same if len(same) > 1 else None
    return None


def _sort(c: str) -> tuple[str, bool]:
    """Letters of one block stand for each other if they are of one category and turn case alike."""
    other = c.swapcase()
    return unicodedata.category(c), other != c and len(other) == 1 and other.swapcase() == c


class Cipher:
    """Keyed permutations of mixed-radix numbers."""

    def __init__(self, key: bytes, turn: int = 0):
        self.key = key + b"\x1e%d" % turn if turn else key

    def number(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")

    def permute(self, tag: str, values: list[int], radix: list[int]) -> list[int]:
        """A permutation of the tuples with these radices: unbalanced Feistel rounds, each half
        shifted in turn by a keyed function of the other."""
        n = len(values)
        if n == 1:
            return [(values[0] + self.number(tag, radix[0])) % radix[0]]
        half = n // 2
        a, b = list(values[:half]), list(values[half:])
        ra, rb = radix[:half], radix[half:]
        for r in range(8):
            x, rx, y = (a, ra, b) if r % 2 == 0 else (b, rb, a)
            f = self.number(tag, r, n, *y)
            for i, m in enumerate(rx):
                f, d = divmod(f, m)
                x[i] = (x[i] + d) % m
                if not f:
                    f = self.number(tag, r, i, *y)
        return a + b

    def recode(self, tag: str, text: str, alphabets: list[str | None]) -> str:
        at = [i for i, a in enumerate(alphabets) if a]
        out = list(text)
        new = self.permute(tag, [alphabets[i].index(text[i]) for i in at], [len(alphabets[i]) for i in at]) if at else []
        for i, v in zip(at, new):
            out[i] = alphabets[i][v]
        return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _luhn_ok(digits: str) -> bool:
    return len(digits) > 1 and _luhn(digits[:-1]) == int(digits[-1])


def _by_sound(c: Cipher, tag: str, name: str) -> str:
    return c.recode(tag, name, [next((a for a in _SOUNDS if x in a), _alphabet(x)) for x in name])


def _iban_rest(value: str) -> int:
    raw = value.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in raw[4:] + raw[:4])) % 97


def _holds(kind: str, value: str) -> bool:
    """Whether a find is what it looks like: check digits of cards and IBANs, digits of a phone number."""
    if kind == "card":
        digits = "".join(x for x in value if x.isdigit())
        return bool(_ISSUER.match(digits)) and _luhn_ok(digits)
    if kind == "iban":
        return _iban_rest(value) == 1
    if kind == "ip6":
        try:
            return int(ip_address(value)) >> 16 > 0  # an address beyond the first few
        except ValueError:
            return False
    return kind != "phone" or 7 <= sum(x.isdigit() for x in value) <= 15


def _country(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in _SHORT_CODES), digits[:3])


def normal(kind: str, value: str) -> tuple[str, str]:
    """What entities that are spelled apart, but are one, have in common."""
    if kind in ("card", "iban"):
        return kind, re.sub(r"[ -]", "", value)
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        return kind, digits if value[0] == "+" else "0" + digits if digits[0] == "0" else "1" + digits
    if kind == "ip" and ":" in value:
        return kind, ip_address(value).exploded
    if kind == "email" or (kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)):
        return kind, value.lower()
    return kind, value


def _parts(name: str) -> list[str]:
    """Words, particles, initials and the spaces between them."""
    return [x for x in re.split(rf"([ ]|(?<!\w){_PARTICLE}|(?<!\w){_INITIAL})", name) if x]


def _is_word(x: str) -> bool:
    return len(x) > 1 and not re.fullmatch(rf"{_PARTICLE}|{_INITIAL}|d['’]", x) and not re.fullmatch(_PARTICLE, x + " ")


def _low(word: str) -> str:
    return "".join(x.lower() if len(x.lower()) == 1 else x for x in word)


def _cased(word: str, like: str) -> str:
    """The word with the capitals of another; where it is longer, all capitals go on."""
    loud = len(like) > 1 and like.isupper()
    up = [x.isupper() for x in like] + [loud] * (len(word) - len(like))
    return "".join(x.upper() if u and len(x.upper()) == 1 else x for x, u in zip(word, up))


def _stand_in(c: Cipher, role: str, word: str, gender: str) -> str:
    """The small letters that stand for a word of a name: permuted, a given name's with its gender's ending."""
    new = _by_sound(c, role, word)
    if role != "given":
        return new
    script = next((k for k, x in enumerate((r"[A-Za-z\u00c0-\u024f]", r"[\u0370-\u03ff]", r"[\u0400-\u04ff]")) if re.match(x, word[-1])), None)
    return new if script is None else new + ENDINGS[gender or "n"][script]


def _last(parts: list[str]) -> int:
    """Which part is the family name."""
    return max((i for i, x in enumerate(parts) if _is_word(x)), default=len(parts) - 1)


def surrogate(c: Cipher, kind: str, value: str) -> str:
    """The stand-in of an entity other than a name."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        # Domains don't tell case; the local part and all labels are recoded, under a reserved ending.
        host = "".join(x.lower() if len(x.lower()) == 1 else x for x in domain)
        new = c.recode("host", host, [_alphabet(x) for x in host])
        low = "".join(x.lower() if len(x.lower()) == 1 else x for x in local)  # one mailbox, however it is cased
        own = c.recode("local", low, [_alphabet(x) for x in low])
        return "".join(y.upper() if x.isupper() and len(y.upper()) == 1 else y for x, y in zip(local, own)) + "@" + new + ".example"
    if kind == "ip" and ":" in value:
        parts = c.permute("ip6", list(ip_address(value).packed), [256] * 16)
        new = str(ip_address(bytes(parts)))
        return new.upper() if value.isupper() else new
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        return ".".join(map(str, c.permute("ip", parts, [256] * 4)))
    if kind == "card":
        at = [i for i, x in enumerate(value) if x.isdigit()]
        digits = "".join(value[i] for i in at)
        body = digits[0] + c.recode(f"card{len(digits)}", digits[1:-1], [DIGITS] * (len(digits) - 2))
        new = body + str(_luhn(body))
        out = list(value)
        for i, x in zip(at, new):
            out[i] = x
        return "".join(out)
    if kind == "iban":
        raw = value.replace(" ", "")
        new = raw[:2] + c.recode("iban", raw[4:], [_alphabet(x) for x in raw[4:]])
        check = 98 - _iban_rest(f"{new[:2]}00{new[2:]}")
        signs = iter(f"{new[:2]}{check:02d}{new[2:]}")
        return "".join(x if x == " " else next(signs) for x in value)
    if kind == "phone":
        # National digits are permuted under their country; a number without one is taken for code 1's.
        digits = re.sub(r"\D", "", value)
        code = _country(digits) if value[0] == "+" else "0" if digits[0] == "0" else ""
        new = iter(code + c.recode("phone" + (code or "1"), digits[len(code) :], [DIGITS] * (len(digits) - len(code))))
        return "".join(next(new) if x.isdigit() else x for x in value)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        new = c.recode("hex", value.lower(), [HEX] * len(value))  # one secret, however it is cased
        return new if value == value.lower() else new.upper()
    return c.recode(kind, value, [_alphabet(x) for x in value])


def detect(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, gender) of the entities of a text, from left to right."""
    if not _MAY.search(text):
        return []
    out, at = [], 0
    while m := _PATTERN.search(text, at):
        kind = m.lastgroup if m.lastgroup in _GROUPS else next(k for k in _GROUPS if m[k] is not None)
        group = {"secret": ("sv", "sw"), "name": ("nv", "uv", "lv")}.get(kind, (kind,))
        group = next(g for g in group if m[g] is not None)
        value, gender = m[group], ""
        if kind == "name":
            title = m["title"] or m["loud"] or m["low"]
            gender = next((g for t in re.findall(r"\w+", title) if (g := _BY_TITLE.get(t.casefold(), "n")) != "n"), "n")
        if not _holds(kind, value):
            at = m.start() + 1  # what it ran over may be something else
            continue
        at = m.end()
        out.append((m.start(group), m.end(group), "ip" if kind == "ip6" else kind, value, gender))
    return _repeats(text, out) if any(x[2] == "name" for x in out) else out


def _repeats(text: str, found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """The finds, and the places where words of the names stand without a title, with a capital: each given name with
    the gender that any title of the document tells."""
    gender, family, forms, givens = {}, set(), set(), _givens(found)
    for *_, kind, value, g in found:
        if kind == "name":
            parts = _parts(value)
            last = _last(parts)
            if len(parts) == 1 and _low(value) in givens:
                parts, last = [value, ""], 1
            for k, x in enumerate(parts):
                if x and (k == last or (k < last and _is_word(x))):
                    forms |= {y for y in (x, x.capitalize(), x.upper()) if y[0].isupper() or not _cases(y[0])}
                if k == last and x:
                    family.add(_low(x))
                elif k < last and _is_word(x) and gender.get(_low(x), "n") == "n":
                    gender[_low(x)] = g
    words = sorted((x for x in forms if (len(x) > 2 or not x.isascii()) and x.casefold() not in _CALENDAR), key=len, reverse=True)
    of = lambda v, g: next((gender[y] for x in _parts(v) if (y := _low(x)) in gender), g)
    found = [(a, b, k, v, of(v, g) if k == "name" else g) for a, b, k, v, g in found]
    if not words:
        return found
    taken, out, k = found, list(found), 0
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)", text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.end() <= taken[k][0]:
            low = _low(m[0])
            out.append((m.start(), m.end(), "family" if low in family else "given", m[0], gender.get(low, "")))
    return sorted(out)


def _givens(found: list[tuple[int, int, str, str, str]]) -> set[str]:
    """Given names of whole names that are no family's there: a title before one alone (``Dr Maria``) means the given name."""
    given, family = set(), set()
    for *_, kind, value, _ in found:
        if kind == "name":
            parts = _parts(value)
            last = _last(parts)
            given |= {_low(x) for x in parts[:last] if _is_word(x)}
            if any(_is_word(x) for x in parts[:last]):
                family.add(_low(parts[last]))
    return given - family


def _cases(c: str) -> bool:
    return c.lower() != c.upper()


#: A word of a name that hasn't found a free stand-in after so many turns gets longer ones.
TURNS = 64


class _Names:
    """Stand-ins of the words of a document's names, one for a word and role; no two are the same, and none is a real word of a name there."""

    def __init__(self, c: Cipher, found: list[tuple[int, int, str, str, str]]):
        self.c, self.mine, self.used, self.gender, self.givens = c, {}, {}, {}, _givens(found)
        for *_, kind, value, gender in found:
            if kind == "name":
                parts = _parts(value)
                for x in parts if _low(value) in self.givens else parts[: _last(parts)]:
                    if self.gender.get(_low(x), "n") == "n":
                        self.gender[_low(x)] = gender
        self.real = {_low(x) for *_, kind, value, _ in found if kind in ("name", "given", "family") for x in _parts(value) if _is_word(x)}

    def word(self, role: str, word: str) -> str:
        own = role, _low(word)
        turn = 0
        while own not in self.mine:
            c = Cipher(self.c.key, turn) if turn else self.c
            new = _stand_in(c, role, own[1], self.gender.get(own[1], "n"))
            for k in range(turn - TURNS + 1):
                new += LOWER[c.number("longer", *own, k) % 26]
            if new not in self.real and self.used.setdefault(new, own) == own:
                self.mine[own] = new
            turn += 1
        return _cased(self.mine[own], word)

    def name(self, value: str) -> str:
        parts = _parts(value)
        family = _last(parts)
        for i, x in enumerate(parts):
            if i != family and (re.fullmatch(_INITIAL, x) or (len(x) == 1 and x.isupper())):
                parts[i] = self.c.recode("initial", x, [_alphabet(y) for y in x])
            elif i == family or _is_word(x):
                parts[i] = self.word("family" if i == family and not (len(parts) == 1 and _low(x) in self.givens) else "given", x)
        return "".join(parts)


def rewrite(c: Cipher, text: str) -> tuple[str, Counter]:
    """The text with its entities replaced, and how many there were of each kind."""
    found = detect(text)
    if not found:
        return text, Counter()
    out, at, seen, names = [], 0, Counter(), _Names(c, found)
    mine: dict[tuple[str, str], int] = {}
    real = {normal(k, v) for _, _, k, v, _ in found}
    used: dict[tuple[str, str], tuple[str, str]] = {}
    for a, b, kind, value, _ in found:
        if kind in ("name", "given", "family"):
            new = names.name(value) if kind == "name" else names.word(kind, value)
        else:
            own = normal(kind, value)
            turn = mine.get(own, 0)
            while True:  # a format has far more values than a text has entities
                new = surrogate(Cipher(c.key, turn) if turn else c, kind, value)
                meets = normal(kind, new)
                if own in mine or (meets not in real and used.setdefault(meets, own) == own):
                    break
                turn += 1
            mine[own] = turn
        out += [text[at:a], new]
        at = b
        seen["name" if kind in ("given", "family") else kind] += 1
    return "".join([*out, text[at:]]), seen


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, made at random and kept there if it has none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def anonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with text rewritten, and n_pii and one count a kind at the end; the key is the
    session's if none is given."""
    modest(docs.sparkSession)
    key = key or session_key(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    clash = {c.lower() for c in docs.columns}
    added = [n if n not in clash else f"pii_{n}" for n in ["n_pii", *counts]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cipher(key)
        for batch in batches:
            col = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [(None, Counter()) if t is None else rewrite(c, t) for t in part.column(col).to_pylist()]
                arrays = [part.column(x) if x != col else pa.array([t for t, _ in made], pa.string()) for x in range(part.num_columns)]
                arrays.append(pa.array([sum(n.values()) for _, n in made], pa.int64()))
                arrays += [pa.array([n[kind] for _, n in made], pa.int64()) for kind in KINDS]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, *added])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{n}` {kinds[n] if n != 'text' else 'string'}" for n in docs.columns), *(f"`{n}` bigint" for n in added)])
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymise(table(spark, sf_dir, "documents"))
