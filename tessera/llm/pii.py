"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within each value's format.

A value that passes its check (Luhn, mod 97, calendar, ranges) is read as a number in the mixed radix of
its own written format, permuted below that format's size by a Feistel network with cycle walking, and
written back in the same format. The permutation depends on the key and the format alone, and each is a
bijection of the format's valid values: equal values get equal pseudonyms in every document, and different
values of a format never meet.

Kinds: card (Luhn, check digit recomputed), iban (mod 97, check digits recomputed), phone, ssn, ip (v4 and
v6), date (ISO, and d/m/y or m/d/y with one or two digits each; calendar days of 1900-2099), email (local
part, and the domain up to its last label), secret (AKIA..., ghp_..., sk-..., and what is assigned to a
token, key or password). A date's format is its separators, its digits, and in which orders it can be read.

Digits of other scripts are read as what they say and written back in their script, so a value is linked to
itself in any script. Values are told from their surroundings by ASCII letters and digits alone: they are found
inside text that is written without spaces.

Defined results: null text stays null with no values, empty text stays empty; repeated rows are rewritten
alike; other columns are untouched, but for those named like a count. A text is scanned whole, whatever its
length. There is no key of its own: one is passed, or named in the session's KEY_SETTING.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import ipaddress
import re
import string
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY_SETTING = "spark.tessera.pii.key"
#: For the test tables, which name nobody; a deployment sets its own.
TABLES_KEY = b"a key for made-up people"
ROUNDS = 8
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email", "secret")
ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
HEX = "0123456789abcdef"
ALNUM_UPPER = string.digits + string.ascii_uppercase
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

#: Digit-led formats. The order matters: the longer and stricter ones come first.
NUMBERS = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<secret>AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})"
    r"|(?P<assigned>(?i:token|secret|password|passwd|api_?key)[\"']?\s*[=:]\s*[\"']?[A-Za-z0-9_/+-]{16,128})"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"|(?P<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){3,4}|\+\d{10,14}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})"
    r"|(?P<card>\d(?:[ -]?\d){12,18})"
    r")(?!\w)",
    re.ASCII,
)
#: The first group of letters and digits of a match; what follows it is scanned again if the match fails its check.
GROUP = re.compile(r"\W*\w+", re.ASCII)
#: Decimal digits of other scripts.
OTHER_DIGIT = re.compile(r"(?![0-9])\d")
#: What comes before an @, and the domain after it.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]{1,64}$"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size); values that leave it walk on until they are back."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, width = (1 << half) - 1, -(-half // 8)
    base = hashlib.blake2b(key=key[:64], person=hashlib.sha256(tweak.encode()).digest()[:16], digest_size=max(1, min(64, width)))
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            h = base.copy()
            h.update(bytes([r]) + right.to_bytes(width, "big"))
            left, right = right, left ^ (_stretch(h.digest(), width) & mask)
        value = left << half | right
        if value < size:
            return value


def _stretch(digest: bytes, width: int) -> int:
    while len(digest) < width:
        digest += hashlib.blake2b(digest).digest()
    return int.from_bytes(digest[:width], "big")


def permuted(text: str, key: bytes, kind: str, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """text with its letters and digits permuted, each within its alphabet; other characters stay."""
    spots, value, size, pattern = [], 0, 1, []
    for i, c in enumerate(text):
        a = next((a for a in alphabets if c in a), None)
        pattern.append(c if a is None else f"\0{a[0]}")
        if a is not None:
            spots.append((i, a))
            value, size = value * len(a) + a.index(c), size * len(a)
    value = feistel(value, size, key, f"{kind}:{''.join(pattern)}")
    out = list(text)
    for i, a in reversed(spots):
        value, k = divmod(value, len(a))
        out[i] = a[k]
    return "".join(out)


def walked(text: str, valid, step) -> str:
    """The first valid text after this one on its cycle; text itself is valid, so the walk ends."""
    text = step(text)
    while not valid(text):
        text = step(text)
    return text


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _shorter(text: str) -> list[str]:
    """The beginnings of text that end before a space or hyphen, longest first."""
    return [text[:i] for i in range(len(text) - 1, 0, -1) if text[i] in " -"]


def card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None

    def step(d: str) -> str:
        body = permuted(d[:-1], key, "card")
        return body + next(c for c in string.digits if luhn(body + c))

    return _refill(text, walked(digits, lambda d: len(set(d)) > 1, step))


def _iban_number(body: str, head: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + head))


def iban(text: str, key: bytes) -> str | None:
    chars = text.replace(" ", "")
    country, body = chars[:2], chars[4:]
    if not 15 <= len(chars) <= 34 or not 2 <= int(chars[2:4]) <= 98 or _iban_number(body, chars[:4]) % 97 != 1:
        return None
    body = permuted(body, key, f"iban{country}")
    return _refill(text, f"{country}{98 - _iban_number(body, country + '00') % 97:02d}{body}")


def phone(text: str, key: bytes) -> str | None:
    plus = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    head, rest = (plus[0], text[plus.end() :]) if plus else ("+", text[1:]) if text[0] == "+" else ("", text)
    if not 7 <= len(_digits(rest)) <= 14:
        return None
    low = lambda t: next(c for c in t if c.isdigit()) in "01"
    # numbers that begin with 0 or 1 are permuted among themselves, and so are the others
    return head + walked(rest, lambda t: low(t) == low(rest), lambda t: permuted(t, key, f"phone{head}"))


def ssn(text: str, key: bytes) -> str | None:
    def valid(t: str) -> bool:
        a, b, c = t.split("-")
        return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"

    return walked(text, valid, lambda t: permuted(t, key, "ssn")) if valid(text) else None


def ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def ip6(text: str, key: bytes) -> str | None:
    """Hex digits are permuted where they stand. Words that could be an address without a digit or with two groups are none."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if not any(c.isdigit() for c in text) or sum(map(bool, text.split(":"))) < 3:
        return None
    if text != text.lower() and text != text.upper():
        return None
    hexes = HEX if text == text.lower() else HEX.upper()
    return permuted(text, key, "ip6", (hexes,))


@functools.cache
def _calendar(wide: tuple[int, int], readings: int) -> tuple[dict[bool, list[tuple[int, int]]], list[int]]:
    """Of slashed dates with so many digits, those that can be read day first (1), month first (2) or both ways (3): by leap year, and how many there are before each year."""
    def ways(a: int, b: int, leap: bool) -> int:
        days = (31, 28 + leap, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
        return (b <= 12 and a <= days[b - 1]) + 2 * (a <= 12 and b <= days[a - 1])

    span = [range(1, 10) if w == 1 else range(1, 32) for w in wide]
    pairs = {leap: [(a, b) for a in span[0] for b in span[1] if ways(a, b, leap) == readings] for leap in (False, True)}
    before = [0]
    for y in range(FIRST_DAY.year, LAST_DAY.year + 1):
        before.append(before[-1] + len(pairs[calendar.isleap(y)]))
    return pairs, before


def date(text: str, key: bytes) -> str | None:
    if "-" in text:
        try:
            day = datetime.date(*map(int, text.split("-")))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        n = (LAST_DAY - FIRST_DAY).days + 1
        return (FIRST_DAY + datetime.timedelta(feistel((day - FIRST_DAY).days, n, key, "date iso"))).isoformat()
    left, right, year = text.split("/")
    wide, pair, y = (len(left), len(right)), (int(left), int(right)), int(year)
    if not FIRST_DAY.year <= y <= LAST_DAY.year:
        return None
    for readings in (3, 1, 2):
        pairs, before = _calendar(wide, readings)
        if pair not in pairs[calendar.isleap(y)]:
            continue
        n = feistel(before[y - FIRST_DAY.year] + pairs[calendar.isleap(y)].index(pair), before[-1], key, f"date {wide} {readings}")
        k = bisect.bisect_right(before, n) - 1
        a, b = pairs[calendar.isleap(FIRST_DAY.year + k)][n - before[k]]
        return f"{a:0{wide[0]}d}/{b:0{wide[1]}d}/{FIRST_DAY.year + k}"
    return None


def secret(text: str, key: bytes) -> str:
    head = re.match(r"AKIA|ghp_|sk-", text)[0]
    return head + permuted(text[len(head) :], key, f"secret{head}", (ALNUM_UPPER,) if head == "AKIA" else ALPHABETS)


def assigned(text: str, key: bytes) -> str:
    """A secret by what it is assigned to: the value changes, hex within hex."""
    value = re.search(r"[A-Za-z0-9_/+-]+$", text)[0]
    is_hex = lambda t: all(c in HEX for c in t)
    if is_hex(value):
        return text[: -len(value)] + permuted(value, key, "assigned", (HEX,))
    return text[: -len(value)] + walked(value, lambda t: not is_hex(t), lambda t: permuted(t, key, "assigned"))


def domain(text: str, key: bytes) -> str:
    """All but the last label, whoever's mail it is."""
    head, dot, last = text.rpartition(".")
    return permuted(head, key, "domain") + dot + last


CHANGE = {"card": card, "iban": iban, "phone": phone, "ssn": ssn, "ip": ip, "ip6": ip6, "date": date, "secret": secret, "assigned": assigned, "domain": domain}
#: What some patterns count as.
COUNTED = {"assigned": "secret", "ip6": "ip"}


class Pseudonymizer:
    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = key
        self.known = functools.lru_cache(1 << 14)(self._new)

    def _new(self, kind: str, value: str) -> str | None:
        return permuted(value, self.key, "email") if kind == "email" else CHANGE[kind](value, self.key)

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}
        # the same places, with digits that the patterns and checks know
        plain = text if text.isascii() else OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
        out: list[str] = []

        def put(at: int, end: int) -> None:
            look = at
            while m := NUMBERS.search(plain, look, end):
                value, new = m[0], self.known(m.lastgroup, m[0])
                if new is None and m.lastgroup == "card":
                    # digits behind a card may have been taken for its own
                    value, new = next(((v, n) for v in _shorter(m[0]) if (n := self.known("card", v))), (value, None))
                if new is None:
                    look = GROUP.match(plain, m.start()).end()
                    continue
                kind = COUNTED.get(m.lastgroup, m.lastgroup)
                counts[kind] = counts.get(kind, 0) + 1
                to = m.start() + len(value)
                out.extend((text[at : m.start()], _written(text[m.start() : to], new)))
                at = look = to
            out.append(text[at:end])

        at, look = 0, plain.find("@")
        while look >= 0:
            local, domain = LOCAL.search(plain, max(at, look - 64), look), DOMAIN.match(plain, look + 1)
            if local and domain and any(c.isalnum() for c in local[0]):
                put(at, local.start())
                for kind, m in (("email", local), ("domain", domain)):
                    out.append(_written(text[m.start() : m.end()], self.known(kind, m[0])))
                    out.append("@" if kind == "email" else "")
                counts["email"] = counts.get("email", 0) + 1
                at = domain.end()
            look = plain.find("@", look + 1)
        put(at, len(text))
        return "".join(out), counts


def _written(old: str, new: str) -> str:
    """new with its digits in the script of the digits of old: place by place where both are as long, else, and where old has a letter, in that of the first one."""
    if old.isascii():
        return new
    zero = [ord(c) - unicodedata.decimal(c) if c.isdecimal() else None for c in old]
    first = next((z for z in zero if z is not None), ord("0"))
    zero = [first if z is None else z for z in zero] if len(old) == len(new) else [first] * len(new)
    return "".join(chr(z + int(c)) if c in string.digits else c for c, z in zip(new, zero, strict=True))


def pseudonymize(docs: DataFrame, key: bytes, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) with text rewritten, and n_pii and a count for each kind found."""
    keep = keep or docs.columns

    def run(text: list) -> list[list]:
        change = _shared(key)
        found = [(None, {}) if t is None else change(t) for t in text]
        return [[t for t, _ in found], [sum(c.values()) for _, c in found], *([c.get(k, 0) for _, c in found] for k in KINDS)]

    names = ["n_pii", *(f"n_{k}" for k in KINDS)]
    added = "text string, " + ", ".join(f"{n} long" for n in names)
    return common.with_columns_by(docs, [c for c in keep if c not in names], {"text": F.col("text")}, run, added, replace=True)


@functools.cache
def _shared(key: bytes) -> Pseudonymizer:
    return Pseudonymizer(key)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or the test tables' key."""
    return (spark.conf.get(KEY_SETTING, None) or "").encode() or TABLES_KEY


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(common.table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with pseudonyms in place of the values found; null and empty texts and repeated rows as they are."""
    names = docs.columns
    out = pseudonymize(docs.select("doc_id", "text", *(c for c in names if c not in ("doc_id", "text"))), session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names)
