"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own validity rules are permuted by a keyed Feistel network within
the set of values of their format, so a pseudonym is as valid as what it stands for, equal values get
equal pseudonyms in every document, and the key's owner can go back (:func:`restore`).

======== ============================================================ ===================================
kind     found where                                                  what is permuted
======== ============================================================ ===================================
card     13-19 digits, spaces or hyphens between groups, Luhn sum     all but the first digit and the
         right, first digit 2-6                                       check digit, which is made anew
iban     country, check digits right by mod 97; in lower case, also   letters and digits of the account
         a length that its country has
phone    + and 10-15 digits, or 3-3-4 digits with separators          all digits but the country's
ssn      3-2-4 digits, area, group and serial in use                  all digits, among numbers in use
ip       four octets of 0-255                                         the address, within its block (see
                                                                      ``BLOCKS``) or among all others
date     Y-M-D, D.M.Y, M/D/Y or D/M/Y, D Month Y, Month D, Y, months  the day, from 1900 to 2099, among days
         in full or cut to three letters; a day of the calendar       that are spelt alike
email    local part and domain                                        letters and digits of the local
                                                                      part, each kind in its place
======== ============================================================ ===================================

A day has one pseudonym in all spellings. It is permuted among days whose numbers have as many digits, whose day is above
12 if its own is, and whose month is May if its own is (which reads alike in full and cut), so every spelling of the
pseudonym can be read back, with or without leading zeros, and a day above 12 tells D/M/Y from M/D/Y. Where both could be
meant, M/D/Y is read. Names of months keep their case and form; "Sept" comes back as "Sep".

Numbers that break the rules of their format stay as they are, and so does all other text. Cards and IBANs are
sought among all spans of whole groups in a run, so other groups beside them do not hide them; where spans overlap,
the first and longest counts. Where a pseudonym and its neighbours would read as other values, it is permuted again
and then differs from the same value's elsewhere. There is no default key: who has the key can go back.

Defined cases: a null text stays null with no findings; an empty one stays empty; texts of any length
are worked on whole, in one task each; repeated rows give repeated rows; an empty table gives an empty
result; extra columns are left out, and columns with the names of results are replaced by them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import ship

ROUNDS = 10
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email")


class Feistel:
    """A keyed permutation of the numbers below size, for each tweak and size."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, size: int, i: int, half: int) -> int:
        said = f"{tweak}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest())

    def _once(self, x: int, a: int, b: int, tweak: str, size: int, back: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            way = -1 if back else 1
            if i % 2:
                right = (right + way * self._round(tweak, size, i, left)) % b
            else:
                left = (left + way * self._round(tweak, size, i, right)) % a
        return left * b + right

    def permute(self, x: int, size: int, tweak: str, back: bool = False, ok: Callable[[int], bool] | None = None) -> int:
        """Walks the permutation of a grid just above size until it is below size and, if asked, ok."""
        if size <= 1:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            x = self._once(x, a, b, tweak, size, back)
            if x < size and (ok is None or ok(x)):
                return x


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10


def _put(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()

#: IPv4 blocks with a meaning of their own (RFC 6890 and RFC 5771).
BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _number(at: str) -> int:
    a, b, c, d = map(int, at.split("."))
    return a << 24 | b << 16 | c << 8 | d


_RANGES = [(_number(at), 1 << 32 - int(bits)) for at, _, bits in (x.partition("/") for x in BLOCKS)]


def _block(address: int) -> tuple[int, int] | None:
    return next(((first, size) for first, size in _RANGES if first <= address < first + size), None)


def _spelt_alike(day: dt.date) -> tuple[bool, bool, int]:
    """What a day's pseudonym has in common with it."""
    return day.month < 10, day.month == 5, (day.day >= 10) + (day.day > 12)


def _like(new: int, old: str) -> str:
    """A number with a leading zero if the old one had one."""
    return str(new).zfill(len(old))


def _in_case(new: str, old: str) -> str:
    return new.upper() if old.isupper() else new.lower() if old.islower() else new


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False) -> None:
        self.net, self.back = Feistel(key), back
        names = "(?i:" + "|".join([*_MONTHS, "Sept", *(m[:3] for m in _MONTHS)]) + r")\b\.?"
        self.pattern = re.compile(
            r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
            r"|(?P<iban>(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9]))"
            r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
            r"|(?P<iso>(?<![\d-])\d{4}-\d{2}-\d{2}(?!-?\d))"
            r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d))"
            r"|(?P<dotted>(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d))"
            r"|(?P<slashed>(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?!/?\d))"
            rf"|(?P<day_month>(?<!\d)\d{{1,2}} (?:{names}),? \d{{4}}(?!\d))"
            rf"|(?P<month_day>\b(?:{names}) \d{{1,2}},? \d{{4}}(?!\d))"
            r"|(?P<one>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d))"
            r"|(?P<plus>(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]\d(?=[ .-]))?(?:[ .-]?\d{2,5}){2,5}(?!\d))"
            r"|(?P<phone>(?<![\d-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-]))"
            r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,}(?!\d))"
        )

    def _number(self, digits: str, tweak: str, ok: Callable[[str], bool] | None = None) -> str:
        """Digits of the same number; both must be ok if that is asked."""
        n = len(digits)
        return str(self.net.permute(int(digits), 10**n, tweak, self.back, ok and (lambda x: ok(str(x).zfill(n))))).zfill(n)

    def email(self, at: str) -> str | None:
        local, _, domain = at.partition("@")
        shape = "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in local)
        size, x = 1, 0
        for c, kind in zip(local.lower(), shape, strict=True):
            base = {"d": 10, "a": 26}.get(kind)
            if base:
                x, size = x * base + (int(c) if base == 10 else ord(c) - 97), size * base
        x = self.net.permute(x, size, f"email|{domain.lower()}|{shape}", self.back)
        out = []
        for c, kind in zip(reversed(local), reversed(shape), strict=True):
            base = {"d": 10, "a": 26}.get(kind)
            if base:
                x, r = divmod(x, base)
                new = str(r) if base == 10 else chr(97 + r)
                c = new.upper() if c.isupper() else new
            out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def iban(self, at: str) -> str | None:
        bare = at.replace(" ", "").upper()
        if not self.valid("iban", at):
            return None
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        size, x, account = 1, 0, bare[4:]
        for c in account:
            base = 10 if c.isdigit() else 26
            x, size = x * base + (int(c) if base == 10 else ord(c) - 65), size * base
        x = self.net.permute(x, size, "iban|" + bare[:2] + "".join("d" if c.isdigit() else "a" for c in account), self.back)
        new = ""
        for c in reversed(account):
            x, r = divmod(x, 10 if c.isdigit() else 26)
            new = (str(r) if c.isdigit() else chr(65 + r)) + new
        new = bare[:2] + str(98 - number(new + bare[:2] + "00") % 97).zfill(2) + new
        it = iter(_in_case(new, at))
        return "".join(c if c == " " else next(it) for c in at)

    def ip(self, at: str) -> str | None:
        octets = at.split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets):
            return None
        own = _number(at)
        block = _block(own)
        if block:
            new = block[0] + self.net.permute(own - block[0], block[1], f"ip|{block[0]}", self.back)
        else:
            new = self.net.permute(own, 1 << 32, "ip", self.back, lambda x: _block(x) is None)
        return ".".join(str(new >> k & 255) for k in (24, 16, 8, 0))

    def _day(self, year: int, month: int, day: int) -> dt.date | None:
        try:
            own = dt.date(year, month, day)
        except ValueError:
            return None
        if not 1900 <= year <= 2099:
            return None
        kind = _spelt_alike(own)
        alike = lambda x: _spelt_alike(dt.date.fromordinal(_FIRST + x)) == kind
        return dt.date.fromordinal(_FIRST + self.net.permute(own.toordinal() - _FIRST, _DAYS, "date", self.back, alike))

    def iso(self, at: str) -> str | None:
        new = self._day(*map(int, at.split("-")))
        return new and new.isoformat()

    def dotted(self, at: str) -> str | None:
        d, m, y = at.split(".")
        new = self._day(int(y), int(m), int(d))
        return new and f"{_like(new.day, d)}.{_like(new.month, m)}.{new.year}"

    def slashed(self, at: str) -> str | None:
        """Month first where that is a date; a pseudonym reads the way it was made, as its day is above 12 if the own is."""
        a, b, y = at.split("/")
        new = self._day(int(y), int(a), int(b))
        if new:
            return f"{_like(new.month, a)}/{_like(new.day, b)}/{new.year}"
        new = self._day(int(y), int(b), int(a))
        return new and f"{_like(new.day, a)}/{_like(new.month, b)}/{new.year}"

    def _named(self, at: str) -> str | None:
        day, name, year = re.search(r"(?<!\d)\d{1,2}(?!\d)", at), re.search(r"[A-Za-z]+", at), re.search(r"\d{4}$", at)
        own = name[0].capitalize()
        month = next(i for i, m in enumerate(_MONTHS, 1) if m.startswith(own[:3]))
        new = self._day(int(year[0]), month, int(day[0]))
        if new is None:
            return None
        shown = _MONTHS[new.month - 1]
        shown = _in_case(shown if own in _MONTHS else shown[:3], name[0])
        parts = sorted([(day.span(), _like(new.day, day[0])), (name.span(), shown), (year.span(), str(new.year))], reverse=True)
        for (a, b), text in parts:
            at = at[:a] + text + at[b:]
        return at

    day_month = month_day = _named

    def ssn(self, at: str) -> str | None:
        used = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        digits = at.replace("-", "")
        return _put(at, self._number(digits, "ssn", used)) if used(digits) else None

    def plus(self, at: str) -> str | None:
        digits = re.sub(r"\D", "", at)
        if not 10 <= len(digits) <= 15:
            return None
        country = 1 if digits[0] in "17" else 2
        return _put(at, digits[:country] + self._number(digits[country:], "phone|" + digits[:country]))

    one = plus

    def phone(self, at: str) -> str | None:
        return _put(at, self._number(re.sub(r"\D", "", at), "phone|1"))

    def card(self, at: str) -> str | None:
        digits = re.sub(r"\D", "", at)
        if luhn(digits) or digits[0] not in "23456":
            return None
        body = digits[0] + self._number(digits[1:-1], "card|" + digits[0])
        return _put(at, body + str(-luhn(body + "0") % 10))

    def valid(self, kind: str, at: str) -> bool:
        if kind == "card":
            digits = re.sub(r"\D", "", at)
            return 13 <= len(digits) <= 19 and digits[0] in "23456" and not luhn(digits)
        bare = at.replace(" ", "").upper()
        if not 15 <= len(bare) <= 34 or not re.match(r"[A-Z]{2}\d{2}", bare):
            return False
        if at.islower() and IBAN_LENGTHS.get(bare[:2]) != len(bare):
            return False
        return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1

    def spans(self, kind: str, at: str) -> list[tuple[int, int]]:
        """The valid values of a run that begin and end with its groups: from the left, the longest at each start."""
        groups, signs = [m.span() for m in re.finditer(r"[0-9A-Za-z]+", at)], 19 if kind == "card" else 34
        out, i = [], 0
        while i < len(groups):
            begin, n, best = groups[i][0], 0, None
            for k in range(i, len(groups)):
                n += groups[k][1] - groups[k][0]
                if n > signs:
                    break
                if self.valid(kind, at[begin : groups[k][1]]):
                    best = k
            if best is None:
                i += 1
            else:
                out.append((begin, groups[best][1]))
                i = best + 1
        return out

    def run(self, kind: str, at: str) -> tuple[str, int]:
        """The run with its values replaced, and how many it has.

        Where a pseudonym would make other values of the run, all are permuted again, so the way back finds the same.
        """
        own, new = self.spans(kind, at), at
        while own:
            for a, b in own:
                new = new[:a] + getattr(self, kind)(new[a:b]) + new[b:]
            if self.spans(kind, new) == own:
                break
        return new, len(own)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it had."""
        found: dict[str, int] = {}

        def put(m: re.Match) -> str:
            kind = m.lastgroup
            if kind in _GROUPED:
                new, n = self.run(kind, m[0])
                if n:
                    found[kind] = found.get(kind, 0) + n
                return new
            new = getattr(self, kind)(m[0])
            if new is None:
                return m[0]
            kind = _KIND_OF.get(kind, kind)
            found[kind] = found.get(kind, 0) + 1
            return new

        return self.pattern.sub(put, text), found


#: Kinds whose values may stand beside other groups in what the pattern takes.
_GROUPED = ("card", "iban")
_KIND_OF = {"iso": "date", "dotted": "date", "slashed": "date", "day_month": "date", "month_day": "date", "plus": "phone", "one": "phone"}


def _worked(batches: Iterator[pa.RecordBatch], key: bytes, back: bool) -> Iterator[pa.RecordBatch]:
    own = Pseudonyms(key, back)
    for batch in batches:
        texts = batch.column("text")
        # All formats have a digit or an @; texts without one pass as they are.
        some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
        counts = {k: [0] * len(texts) for k in KINDS}
        new: dict[int, str] = {}
        for i in pc.indices_nonzero(some).to_pylist():
            text, found = own.replace(texts[i].as_py())
            if found:
                new[i] = text
                for k, n in found.items():
                    counts[k][i] = n
        if new:
            mask = pa.array([i in new for i in range(len(texts))])
            texts = pc.replace_with_mask(texts, mask, pa.array(new.values(), texts.type))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), texts, *(pa.array(counts[k], pa.int64()) for k in KINDS)],
            names=["doc_id", "text", *(f"n_{k}" for k in KINDS)],
        )


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id", back: bool = False) -> DataFrame:
    """Per row: doc_id, the text with pseudonyms, and the number of values of each kind."""
    if not key:
        raise ValueError("pseudonyms need a key")
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, " + ", ".join(f"n_{k} long" for k in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _worked(batches, key, back)

    return rows.mapInArrow(run, schema)


def restore(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What :func:`pseudonymised` made, taken back."""
    return pseudonymised(docs, key, text, doc_id, back=True)
