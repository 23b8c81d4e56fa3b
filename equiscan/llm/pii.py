"""Format-preserving pseudonyms by a keyed Feistel network.

A value that passes its check (calendar date, octets, check digits, the shape of a phone number or address) is written as
a number within its format, that number is permuted by a Feistel network under a secret key, and walked on until the result
passes the same check. Within a format this is a bijection, so equal values stay equal in all documents and different ones
different, and nothing but the key links them to the originals.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from equiscan.session import ship_package

ROUNDS = 8
KINDS = ["email", "phone", "card", "ssn", "iban", "ip", "date"]

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
#: Any value has one of these characters in it; most texts have none.
_HINT = re.compile("[0-9@]")
#: One pattern for all kinds: where two could begin at one place, the first that matches counts. Within a run of characters
#: that may stand before an @ only a bounded part is tried from each place, so long words cost no more than their length.
_VALUES = re.compile(
    r"(?P<email>(?:(?<![\w.%+-])[\w.%+-]++|[\w.%+-]{1,64}+)@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9]))"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9/-]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]))"
)


class Feistel:
    """Keyed permutation of the numbers below ``size``, another one for every ``tweak``."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, value: int, size: int, tweak: str, passes: Callable[[int], bool] = lambda _: True) -> int:
        """The image of ``value``: walks on while the result is out of range or fails; ``value`` itself must pass."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for i in range(ROUNDS):
                message = f"{tweak}:{size}:{i}:{right}".encode()
                digest = hashlib.blake2b(message, key=self.key, digest_size=max(16, half // 8 + 8)).digest()
                left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
            value = left << half | right
            if value < size and passes(value):
                return value


def luhn(number: str) -> bool:
    digits = [int(d) for d in reversed(number)]
    return sum(digits[::2] + [d * 2 - 9 * (d > 4) for d in digits[1::2]]) % 10 == 0


def _symbols(text: str, feistel: Feistel, tweak: str, passes: Callable[[str], bool] = lambda _: True, tied: bool = False) -> str:
    """Permute letters and digits, each within its class; everything else and the case of each letter stays.

    ``tied`` makes values that differ in case only one value.
    """
    lowered = "".join(c.lower() if c.isascii() else c for c in text) if tied else text
    alphabets = [_DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _LOWER.upper() if c in _LOWER.upper() else "" for c in lowered]
    size = number = 0
    size = 1
    for c, alphabet in zip(lowered, alphabets, strict=True):
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    if size == 1:
        return text

    def written(n: int) -> str:
        out = []
        for c, alphabet in zip(reversed(lowered), reversed(alphabets), strict=True):
            if alphabet:
                n, i = divmod(n, len(alphabet))
                c = alphabet[i]
            out.append(c)
        return "".join(reversed(out))

    shape = "".join("9" if a == _DIGITS else "a" if a == _LOWER else "A" if a else c for c, a in zip(lowered, alphabets, strict=True))
    new = written(feistel.permute(number, size, f"{tweak}:{shape}", lambda n: passes(written(n))))
    return "".join(n.upper() if tied and o != low else n for n, o, low in zip(new, text, lowered, strict=True))


def _email(value: str, feistel: Feistel) -> str:
    local, host = value.rsplit("@", 1)
    # The registered domain stays and what stands before it is permuted along; short names take their domain with them,
    # for among few possible values one is likely to be its own image.
    kept = host.rsplit(".", 1 if len(local) < 5 else 2)[1:]
    first = host[: len(host) - sum(len(k) + 1 for k in kept)]
    new = _symbols(f"{local}@{first}", feistel, "email", tied=True)
    return ".".join([new, *kept]) if first else new + ".".join(kept)


def _phone(value: str, feistel: Feistel) -> str:
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", value).group()
    return country + _symbols(value[len(country) :], feistel, f"phone:{country}")


def _card(value: str, feistel: Feistel) -> str | None:
    digits = re.sub("[ -]", "", value)
    if not luhn(digits):
        return None
    new = iter(_symbols(digits, feistel, "card:True", luhn))
    return "".join(next(new) if c in _DIGITS else c for c in value)


def _valid_ssn(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ssn(value: str, feistel: Feistel) -> str | None:
    return _symbols(value, feistel, "ssn", _valid_ssn) if _valid_ssn(value) else None


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def _iban(value: str, feistel: Feistel) -> str | None:
    country, check, account = value[:2], value[2:4], value[4:]
    if int(check) != _iban_check(country, account):
        return None
    account = _symbols(account, feistel, f"iban:{country}")
    return f"{country}{_iban_check(country, account):02d}{account}"


def _ip(value: str, feistel: Feistel) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    number = feistel.permute(int.from_bytes(map(int, octets), "big"), 2**32, "ip")
    return ".".join(map(str, number.to_bytes(4, "big")))


def _date(value: str, feistel: Feistel) -> str | None:
    """Within its century; the three ways to write a day give one pseudonym."""
    iso, mark = value[4] == "-", value[2]
    parts = value.split("-") if iso else value.split(mark)[::-1]
    swapped = False
    try:
        day = datetime.date(*map(int, parts))
    except ValueError:
        if iso or mark != "/":
            return None
        try:  # month first
            day, swapped = datetime.date(int(parts[0]), int(parts[2]), int(parts[1])), True
        except ValueError:
            return None
    first = datetime.date(max(1, day.year // 100 * 100), 1, 1).toordinal()
    last = datetime.date(day.year // 100 * 100 + 99, 12, 31).toordinal()

    def passes(n: int) -> bool:
        # A day written month first must still be read that way.
        return not swapped or datetime.date.fromordinal(first + n).day > 12

    new = datetime.date.fromordinal(first + feistel.permute(day.toordinal() - first, last - first + 1, f"date:{first}:{swapped}", passes))
    if iso:
        return new.isoformat()
    two = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{two[0]:02d}{mark}{two[1]:02d}{mark}{new.year:04d}"


_PSEUDONYM = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "iban": _iban, "ip": _ip, "date": _date}


def pseudonymised(text: str, feistel: Feistel) -> tuple[str, Counter]:
    """The text with every validated value replaced, and how many of each kind there were."""
    counts: Counter = Counter()
    if not _HINT.search(text):
        return text, counts

    def replace(match: re.Match) -> str:
        kind = match.lastgroup
        new = _PSEUDONYM[kind](match.group(), feistel)
        if new is None:
            return match.group()
        counts[kind] += 1
        return new

    return _VALUES.sub(replace, text), counts


def _replaced(key: bytes, at: int, schema: pa.Schema):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(at):
                new, n = (None, {}) if text.as_py() is None else pseudonymised(text.as_py(), feistel)
                texts.append(new)
                counts.append([n.get(k, 0) for k in KINDS])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, schema.field(at).type)
            columns.append(pa.array([dict(zip(KINDS, c, strict=True)) for c in counts], schema.field(len(columns)).type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return replace


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", counts_col: str = "pii_counts") -> DataFrame:
    """All columns of ``docs`` with the values in ``text_col`` replaced, and ``counts_col``, a struct of counts by kind.

    Mail addresses, phone numbers, card numbers with a right check digit, social security numbers, bank account numbers,
    IPv4 addresses and dates keep their format. Values that fail their check stay.

    Null stays null, an empty text empty; texts of any length are scanned whole. Repeated rows get equal results. A column
    of ``docs`` named like ``counts_col`` gives way to it. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(docs.sparkSession)
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != counts_col.lower()))
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(counts_col, T.StructType([T.StructField(k, T.LongType()) for k in KINDS]))]
    )
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return docs.mapInArrow(_replaced(key, at, to_arrow_schema(schema)), schema)
