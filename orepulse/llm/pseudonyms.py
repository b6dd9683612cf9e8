"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are found by pattern and must pass the check of their kind (Luhn, IBAN remainder, numbering plan, octets, calendar).
A keyed Feistel network permutes the values of a format, so a pseudonym is again a valid value of the same format and layout, equal
values get equal pseudonyms in every document, and the holder of the key can turn them back.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re

from pyspark.sql import DataFrame

from orepulse.llm.common import per_batch

ROUNDS = 10

# Shapes of the formats. Each is confirmed by a validation before anything is replaced.
PATTERN = re.compile(
    r"(?<![\w.@+-])(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?)@(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w@]))"
    r"|(?<![\w.+-])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?!\w)"
    r"|(?<![\w.-])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"
    r"|(?<![\w.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)"
    r"|(?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-]|\.\d)"
    r"|(?<![\w+.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-]|\.\d)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?P<sep>[.-])\d{3}(?P=sep)\d{4})(?![\w-]|\.\d)"
)
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()


def _round_value(key: bytes, kind: str, number: int, half: int, modulus: int) -> int:
    message = f"{kind}|{number}|{modulus}|{half}".encode()
    wide = hmac.new(key, message, hashlib.sha256).digest()
    while len(wide) * 8 < modulus.bit_length() + 64:
        wide += hmac.new(key, wide[-32:], hashlib.sha256).digest()
    return int.from_bytes(wide, "big") % modulus


def permute(value: int, left: int, right: int, key: bytes, kind: str, back: bool = False) -> int:
    """Feistel permutation of ``0 .. left * right - 1``; the halves are added to each other in turn, modulo their sizes."""
    a, b = divmod(value, right)
    for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if number % 2 == 0:
            a = (a + sign * _round_value(key, kind, number, b, left)) % left
        else:
            b = (b + sign * _round_value(key, kind, number, a, right)) % right
    return a * right + b


def permute_text(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """Permute the letters and digits of a text within their classes; every other character keeps its place."""
    classes = [next((c for c in (DIGITS, LOWER, UPPER) if ch in c), "") for ch in text]
    places = [i for i, c in enumerate(classes) if c]
    if not places:
        return text
    middle = len(places) // 2
    sizes = [1, 1]
    value = 0
    for k, i in enumerate(places):
        value = value * len(classes[i]) + classes[i].index(text[i])
        sizes[k >= middle] *= len(classes[i])
    shape = "".join("dlu"[(DIGITS, LOWER, UPPER).index(classes[i])] for i in places)
    value = permute(value, sizes[0], sizes[1], key, f"{kind}|{shape}", back)
    out = list(text)
    for i in reversed(places):
        value, digit = divmod(value, len(classes[i]))
        out[i] = classes[i][digit]
    return "".join(out)


def walk(text: str, key: bytes, kind: str, valid, back: bool = False) -> str:
    """Cycle walking: permute until the result is valid again, which keeps it a permutation of the valid values."""
    text = permute_text(text, key, kind, back)
    while not valid(text):
        text = permute_text(text, key, kind, back)
    return text


def luhn_digit(digits: str) -> str:
    doubled = [int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return str(-sum(doubled) % 10)


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def valid_american(digits: str) -> bool:
    return digits[0] in "23456789" and digits[3] in "23456789" and digits[1:3] != "11" and digits[4:6] != "11"


def _relay(layout: str, digits: str) -> str:
    """Write ``digits`` into the digit places of ``layout``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in layout)


def _date(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in re.split(r"\D", text)]
    iso = len(re.match(r"\d+", text).group()) == 4
    day_first = not iso and ("." in text or parts[0] > 12)
    year, month, day = parts if iso else (parts[2], parts[1], parts[0]) if day_first else (parts[2], parts[0], parts[1])
    try:
        value = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= value <= LAST_DAY:
        return None
    while True:  # days up to the 12th stay among themselves, so that day and month are told apart as before; all layouts agree
        value = FIRST_DAY + permute(value - FIRST_DAY, 271, 270, key, "date", back)
        if value <= LAST_DAY and ((moved := datetime.date.fromordinal(value)).day > 12) == (day > 12):
            break
    new = (moved.year, moved.month, moved.day) if iso else (moved.day, moved.month, moved.year) if day_first else (moved.month, moved.day, moved.year)
    padded = all(len(p) > 1 for p in re.split(r"\D", text))
    seps = re.findall(r"\D", text)
    shown = [f"{n:02d}" if padded else str(n) for n in new]
    return shown[0] + seps[0] + shown[1] + seps[1] + shown[2]


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one value (its origin with ``back``), or None if the value is not valid for its kind."""
    digits = "".join(c for c in text if c.isdigit())
    if kind == "email":
        return permute_text(text, key, kind, back)
    if kind == "date":
        return _date(text, key, back)
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = walk(digits[:-1], key, kind, lambda d: len(set(d + luhn_digit(d))) > 1, back)
        return _relay(text, body + luhn_digit(body))
    if kind == "iban":
        plain = text.replace(" ", "")
        country, account = plain[:2], plain[4:]
        if iban_check(country, account) != plain[2:4]:
            return None
        account = permute_text(account, key, f"iban{country}", back)
        rest = iter(country + iban_check(country, account) + account)
        return "".join(c if c == " " else next(rest) for c in text)
    if kind == "ip":
        octets = [int(o) for o in text.split(".")]
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in text.split(".")):
            return None
        value = permute(int.from_bytes(bytes(octets), "big"), 1 << 16, 1 << 16, key, kind, back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "ssn":
        return _relay(text, walk(digits, key, kind, valid_ssn, back)) if valid_ssn(digits) else None
    if kind == "phone":
        country = re.match(r"\+(\d{1,3}?)(?=\D)|\+(\d)|", text)
        prefix = country.group(1) or country.group(2) or ""
        national = digits[len(prefix) :]
        if prefix in ("", "1") and len(national) == 10:
            known = valid_american(national)
            if not known and not prefix:
                return None
            return _relay(text, prefix + walk(national, key, "phone1", lambda d: valid_american(d) == known, back))
        if not prefix or not 7 <= len(digits) <= 15:
            return None
        return _relay(text, prefix + permute_text(national, key, f"phone{prefix}", back))
    return None


def replace_all(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, int]:
    """The text with every valid value replaced, and how many there were."""
    if not text:
        return text, 0
    found = 0

    def swap(match: re.Match) -> str:
        nonlocal found
        kind = match.lastgroup
        new = pseudonym(kind, match.group(kind), key, back)
        if new is None:
            return match.group()
        found += 1
        return match.group().replace(match.group(kind), new, 1)

    return PATTERN.sub(swap, text), found


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``doc_id, text, n_replaced`` for every row of ``docs``; ``back`` restores the original texts.

    Null texts stay null and empty ones empty, both with 0; rows that share an id are handled each for itself; invalid look-alikes
    (a card number with a wrong check digit, the 31st of February, an octet above 255) are left as they are.
    """

    def work(texts: list) -> list:
        return list(zip(*[replace_all(t, key, back) for t in texts])) or [[], []]

    return per_batch(docs.select("doc_id", "text"), work, "text string, n_replaced long")
