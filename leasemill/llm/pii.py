"""PII: format-preserving Feistel pseudonyms.

Found numbers, dates, addresses and keys are replaced by others of the same format: every value is numbered within its format's
domain, the number goes through a keyed Feistel permutation, and the result is written in the format again. Check digits
stay right and dates stay dates. The permutation depends on the key and the kind alone, so equal values have equal pseudonyms in
all documents, different values different ones, and whoever has the key can take them back (``reveal``).

| kind | found | permuted within |
| --- | --- | --- |
| card | 13 to 19 digits with a right Luhn digit, with single blanks or hyphens between any of them | the same length, Luhn digit made anew |
| account | 13 to 19 digits without, in one run or in groups of four | the same length without a right Luhn digit |
| iban | country, check digits, 11 to 30 letters and digits, remainder 1; with blanks or hyphens in the country's length | the same letters' and digits' places, check digits made anew |
| ssn | ddd-dd-dddd with valid parts | valid numbers |
| phone | +c (ddd) ddd-dddd, +cc ddd ... with 9 to 15 digits; national (ddd) ddd-dddd, ddd-ddd-dddd, 0ddd ddd... with 9 to 12 | digits after the country code or the leading 0 |
| ip | four numbers up to 255 | all addresses |
| date | yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy or dd/mm/yyyy of the years 1900 to 2099, day and month also with one digit | the days of those years; one digit stays one digit |
| email | local@domain.tld | letters and digits of the local part and of the domain's names, but for the last |
| secret | 32 or more hexadecimal digits in any case | hexadecimal digits; of both cases where both are used |

Blanks and hyphens within a card, an account, an IBAN or a national number play no part in its pseudonym and stay where they are.
Where a value ends follows from its grouping and from checks that its pseudonym passes as well, so that ``reveal`` finds the same
places: digits in groups with a right Luhn digit are a card as a whole, unless a card of four fours, 4-6-5 or 4-6-4 digits is among them.
Values of one format that may collide with other kinds (an account whose pseudonym had a right Luhn digit) walk on along
the permutation's cycle until they are of their own kind again.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
REACH = 128
#: Domains of more bits are named in hexadecimal digits, and their permutations are not kept.
LONG_BITS = 4096

_FORMS = r"""
    (?<![\w.+-])(?P<email>[\w.+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![\w@]))
  | (?<![\w])(?P<secret>[0-9A-Fa-f]{32,})(?!\w)
  | (?<![\w])(?P<iban>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|[ -]?[A-Z0-9](?:[ -]?[A-Z0-9]){10,29}))(?!\w)
  | (?<![\w.+])(?P<date>(?:19|20)\d\d-\d\d?-\d\d?|\d\d?[./]\d\d?[./](?:19|20)\d\d)(?![\w])
  | (?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d))
  | (?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
  | (?<![\w.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\w]|\.\d)
  | (?<![\w.-])(?P<national>(?:1[ .-])?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}
      |0[1-9](?:[ .-]\d\d){4}
      |(?!(?:\d{4}[ -]){3}\d{4})(?:\(0[1-9]\d{1,4}\)[ ]?|0[1-9]\d{1,4}[ /-])\d{2,8}(?:[ -]\d{2,8}){0,2})(?!\w|[.-]\d)
  | (?<![\w.-])(?P<number>(?=(?:[ -]?\d){13})\d{1,20}(?:[ -]\d{1,20}){0,19})(?!\w)
"""
_PATTERN = re.compile(_FORMS, re.VERBOSE)
#: The same forms one by one, for places whose first form fails its check.
_EACH = [re.compile(form, re.VERBOSE) for form in re.split(r"\n  \| ", _FORMS)]
#: A digit, an @, or a secret that begins with 32 letters.
_WORTH = re.compile(r"[0-9@]|(?<!\w)[A-Fa-f]{32}")
_END, _LAST = re.compile(r"(?!\w|-\d)"), re.compile(r"(?!\w|[ -]\d)")
_DAY_OR_SSN = re.compile(r"(?<!\d)(?:\d{3}-\d\d-\d{4}|\d{4}-\d\d?-\d\d?)(?!\d)")
_LAYOUTS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
#: How long the IBANs of a country are.
_IBAN_LENGTHS = {country: int(part[:2]) for part in (
    "15NO 16BE 18DKFIFKFONLSD 19MKSI 20ATBAEEKZLTLUMNXK 21CHHRLILV 22BGBHCRDEGBGEIEMERSVA 23AEGIILIQOMSOTL 24ADCZESMDPKSASESKTNVG 25LYPTST 26ISTR "
    "27BIDJFRGRITMCMRSM 28ALAZBYCYDOGTHNHULBNIPLSV 29BREGPSQAUA 30JOKWMUYE 31MTSC 32LC 33RU").split() for country in re.findall("[A-Z]{2}", part[2:])}
_PLACE = {c: (alphabet, i) for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                           "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
          for i, c in enumerate(alphabet)}
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1


class Permutation:
    """A keyed permutation of 0 .. size - 1: a Feistel network on two halves a little too wide, walked until it is inside again."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        # A half is a power of two, so shifts and masks keep the time of very long values in proportion.
        self.bits = ((size - 1).bit_length() + 1) // 2
        self.mask = (1 << self.bits) - 1
        self.width = (self.bits + 16) // 8 + 8
        name = str(size) if size.bit_length() <= LONG_BITS else f"0x{size:x}"
        self.seed = hashlib.blake2b(f"{tweak}:{name}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, value: int) -> int:
        data = hashlib.blake2b(i.to_bytes(1, "little") + value.to_bytes(self.width, "little"), key=self.seed)
        out = []
        for n in range(-(-self.width // 64)):
            block = data.copy()
            block.update(n.to_bytes(1 if n < 256 else 4, "little"))
            out.append(block.digest())
        return int.from_bytes(b"".join(out)[: self.width], "little") & self.mask

    def forward(self, x: int) -> int:
        while True:
            left, right = x >> self.bits, x & self.mask
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, right)) & self.mask
            x = left << self.bits | right
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            left, right = x >> self.bits, x & self.mask
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._round(i, left)) & self.mask, left
            x = left << self.bits | right
            if x < self.size:
                return x


def luhn_digit(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country)) * 100 % 97


class Pseudonyms:
    """Pseudonyms under one key, and the way back."""

    def __init__(self, key: bytes):
        self.key = key
        self.kept: dict[tuple[str, int], Permutation] = {}

    def _permuted(self, kind: str, size: int, x: int, back: bool, inside: Callable[[int], bool] = lambda x: True) -> int:
        permutation = self.kept.get((kind, size)) if size.bit_length() <= LONG_BITS else Permutation(self.key, kind, size)
        if permutation is None:
            if len(self.kept) > 10_000:
                self.kept.clear()
            permutation = self.kept[kind, size] = Permutation(self.key, kind, size)
        while True:
            x = permutation.backward(x) if back else permutation.forward(x)
            if inside(x):
                return x

    def _characters(self, kind: str, value: str, back: bool) -> str:
        """Permutes the digits and letters of a value, each within its own alphabet; everything else stays."""
        places = [_PLACE.get(c) for c in value]
        number, size = 0, 1
        for p in places:
            if p:
                number, size = number * len(p[0]) + p[1], size * len(p[0])
        shape = "".join(p[0][0] if p else c for p, c in zip(places, value))
        number = self._permuted(f"{kind}:{shape}", size, number, back)
        out = []
        for p, c in zip(reversed(places), reversed(value)):
            if p:
                number, i = divmod(number, len(p[0]))
                c = p[0][i]
            out.append(c)
        return "".join(reversed(out))

    def change(self, kind: str, value: str, back: bool = False) -> str:
        """The pseudonym of a found value, or with ``back`` the value of a pseudonym."""
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            n = len(digits) - 1
            alike = lambda x: _begins(str(x).zfill(n) + "0") == _begins(digits)
            body = str(self._permuted(kind, 10**n, int(digits[:-1]), back, alike)).zfill(n)
            return _refill(value, body + str(luhn_digit(body)))
        if kind == "account":
            digits = re.sub(r"\D", "", value)
            n = len(digits)
            wrong = lambda x: luhn_digit(str(x).zfill(n)[:-1]) != x % 10 and _begins_with_card(str(x).zfill(n)) == _begins_with_card(digits)
            return _refill(value, str(self._permuted(kind, 10**n, int(digits), back, wrong)).zfill(n))
        if kind == "iban":
            country, plain = value[:2], _plain(value)
            body = self._characters(f"iban:{country}", plain[4:], back)
            return _refill(value, f"{country}{98 - _iban_rest(country, body):02d}{body}")
        if kind == "ssn":
            x = self._permuted(kind, 10**9, int(value.replace("-", "")), back, lambda x: _valid_ssn(f"{x:09d}"))
            return f"{x:09d}"[:3] + "-" + f"{x:09d}"[3:5] + "-" + f"{x:09d}"[5:]
        if kind == "ip":
            return str(ipaddress.IPv4Address(self._permuted(kind, 1 << 32, int(ipaddress.IPv4Address(value)), back)))
        if kind == "date":
            form = _date_form(value)
            day = datetime.datetime.strptime(value, form).date().toordinal() - _FIRST_DAY

            def inside(d: int) -> bool:
                written = _written_date(d, form, value)
                return len(written) == len(value) and _date_form(written) == form

            return _written_date(self._permuted(form, _DAYS, day, back, inside), form, value)
        if kind == "phone" and value[0] != "+":
            digits = re.sub(r"\D", "", value)
            trunk = not _THREE_THREE_FOUR.fullmatch(value)
            kept = 1 if trunk or len(digits) == 11 else 0
            n = len(digits) - kept
            inside = lambda x: not trunk or x >= 10 ** (n - 1)
            return _refill(value, digits[:kept] + str(self._permuted("phone:", 10**n, int(digits[kept:]), back, inside)).zfill(n))
        if kind == "phone":
            country = re.match(r"\+\d{1,3}(?=\D)|\+\d", value).group()
            digits = re.sub(r"\D", "", value[len(country):])
            number = str(self._permuted(f"phone:{country}", 10 ** len(digits), int(digits), back)).zfill(len(digits))
            return country + _refill(value[len(country):], number)
        if kind == "email":
            name, last = value.rsplit(".", 1)
            return f"{self._characters(kind, name, back)}.{last}"
        if kind == "secret":
            if not (value.islower() or value.isupper() or value.isdigit()):
                return self._mixed(value, back)
            upper = value.upper() == value and value.lower() != value
            x = self._permuted(kind, 16 ** len(value), int(value, 16), back)
            return f"{x:0{len(value)}X}" if upper else f"{x:0{len(value)}x}"
        raise ValueError(kind)

    def _mixed(self, value: str, back: bool) -> str:
        """The pseudonym of hexadecimal digits of both cases, which has both again."""
        def inside(x: int) -> bool:
            made = _both_cases(x, len(value))
            return made.lower() != made != made.upper()

        size = len(_BOTH_CASES) ** len(value)
        return _both_cases(self._permuted("secret:mixed", size, _number_of(value), back, inside), len(value))

    def text(self, text: str | None, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with its values changed, and (kind, start, end) of each in the text given."""
        if not text or not _WORTH.search(text):
            return text, []
        out, found, at = [], [], 0
        for kind, start, end in find(text):
            out += [text[at:start], self.change(kind, text[start:end], back)]
            found.append((kind, start, end))
            at = end
        return "".join([*out, text[at:]]) if found else text, found

    def reveal(self, text: str | None) -> str | None:
        return self.text(text, back=True)[0]


_BOTH_CASES = "0123456789abcdefABCDEF"
_THREE_THREE_FOUR = re.compile(r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}")


def _number_of(value: str) -> int:
    """The number that hexadecimal digits of both cases write, half by half."""
    if len(value) == 1:
        return _BOTH_CASES.index(value)
    half = len(value) // 2
    return _number_of(value[:-half]) * len(_BOTH_CASES) ** half + _number_of(value[-half:])


def _both_cases(x: int, n: int) -> str:
    """The way back from ``_number_of``, to ``n`` digits."""
    if n == 1:
        return _BOTH_CASES[x]
    upper, lower = divmod(x, len(_BOTH_CASES) ** (n // 2))
    return _both_cases(upper, n - n // 2) + _both_cases(lower, n // 2)


def _plain(value: str) -> str:
    return value.replace(" ", "").replace("-", "")


def _refill(form: str, plain: str) -> str:
    rest = iter(plain)
    return "".join(next(rest) if c.isalnum() else c for c in form)


def _right_luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1])


def _begins(digits: str) -> tuple[bool, bool]:
    """What a card's pseudonym has in common with it besides: it begins with a card or not, and as a national number does or not."""
    return _begins_with_card(digits), digits[0] == "0" != digits[1]


def _begins_with_card(digits: str) -> bool:
    """Whether more than 16 digits begin with a card's 16, so that four groups of four and a rest are a card and something else."""
    return len(digits) > 16 and _right_luhn(digits[:16])


def _valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _date_form(value: str) -> str | None:
    """How a date is written; 12/11/2020 counts as month first, as does every date that can be read in that way."""
    forms = ("%Y-%m-%d",) if "-" in value else ("%d.%m.%Y",) if value.count(".") == 2 else ("%m/%d/%Y", "%d/%m/%Y")
    for form in forms:
        try:
            datetime.datetime.strptime(value, form)
            return form
        except ValueError:
            pass
    return None


def _written_date(day: int, form: str, like: str) -> str:
    """A day in the form of a date, with one digit where the date has one; longer than the date where one doesn't do."""
    separator = form[2]
    parts = datetime.date.fromordinal(day + _FIRST_DAY).strftime(form).split(separator)
    return separator.join(p.removeprefix("0") if len(one) == 1 else p for p, one in zip(parts, like.split(separator)))


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every validated value, in order; a candidate that fails its check is not touched."""
    out = []
    at = last = 0
    while sign := _WORTH.search(text, at):
        # Every value has a digit or an @, and begins at most REACH characters before its first.
        here = sign.start()
        start = here
        while start > max(at, here - REACH) and not text[start - 1].isspace():
            start -= 1
        at = here + 1
        for begin in range(start, here + 1):
            if found := _found(text, begin, last):
                out.append((found[0], begin, found[1]))
                at = last = found[1]
                break
    return out


def _found(text: str, begin: int, last: int) -> tuple[str, int] | None:
    """Kind and end of the value that begins here: the first form that matches and passes its check."""
    first = _PATTERN.match(text, begin)
    if not first:
        return None
    # Whether digits begin here: none stand before a blank or hyphen but those of the value found last.
    fresh = begin <= last + 1 or not re.search(r"\d[ -]\Z", text[max(0, begin - 2) : begin])
    for m in (first, *(f.match(text, begin) for f in _EACH)):
        if m:
            kind, value = m.lastgroup, m.group(m.lastgroup)
            if kind == "number":
                if got := _number(text, begin, value, fresh):
                    return got[0], begin + got[1]
            elif kind == "iban":
                if n := _iban(value):
                    return kind, begin + n
            elif kind == "national":
                if (fresh or _THREE_THREE_FOUR.fullmatch(value)) and (n := _national(value)):
                    return "phone", begin + n
            elif got := _kind(kind, value):
                return got, m.end()
    return None


def _number(text: str, begin: int, run: str, fresh: bool) -> tuple[str, int] | None:
    """Kind and length of the card or account that a run of digits in groups begins with."""
    groups = re.split("[ -]", run)
    sizes = [len(g) for g in groups]

    def upto(n: int) -> tuple[str, int]:
        return "".join(groups[:n]), sum(sizes[:n]) + n - 1

    def ends(n: int) -> bool:
        return _END.match(text, begin + upto(n)[1]) is not None

    if 13 <= sizes[0] <= 19 and ends(1):
        return "card" if _right_luhn(groups[0]) else "account", sizes[0]
    whole = 13 <= sum(sizes) <= 19 and _LAST.match(text, begin + len(run)) is not None
    for layout in _LAYOUTS:
        n = len(layout)
        if sizes[:n] == layout and ends(n) and _right_luhn(upto(n)[0]):
            return "card", upto(n)[1]
    kind = "card" if _right_luhn("".join(groups)) else "account"
    if sizes[:4] == _LAYOUTS[0]:
        return (kind, len(run)) if whole else ("account", upto(4)[1]) if ends(4) else None
    # Other groupings count from where the digits begin, and where no undivided number and no layout of another value is among them.
    if not (whole and fresh and kind == "card") or max(sizes) >= 13 or _DAY_OR_SSN.search(run):
        return None
    if any(sizes[k : k + len(layout)] == layout for k in range(len(sizes)) for layout in (*_LAYOUTS, [3, 3, 4])):
        return None
    return kind, len(run)


def _national(value: str) -> int:
    """How much of a candidate is a national number: whole groups of 9 to 12 digits together, as many as do. 0: none."""
    while len(digits := re.sub(r"\D", "", value)) > 12 and (cut := max(value.rfind(" "), value.rfind("-"))) > 0:
        value = value[:cut]
    return len(value) if 9 <= len(digits) <= 12 else 0


def _iban(value: str) -> int:
    """How much of a candidate is an IBAN: an undivided one as a whole, a divided one in its country's length. 0: none."""
    head = re.match(r"[A-Z0-9]+", value).group()
    length = _IBAN_LENGTHS.get(value[:2])
    if len(head) < 15:
        at, seen = 0, 0
        while at < len(value) and (length is None or seen < length):
            seen += value[at] not in " -"
            at += 1
        head = value[:at]
        if length is not None and (seen < length or value[at : at + 1].isalnum()):
            return 0
    plain = _plain(head)
    return len(head) if int(plain[2:4]) == 98 - _iban_rest(plain[:2], plain[4:]) else 0


def _kind(kind: str, value: str) -> str | None:
    """The kind of a candidate that passes its check."""
    good = {
        "ip": lambda: all(str(int(p)) == p and int(p) < 256 for p in value.split(".")),
        "date": lambda: _date_form(value) is not None,
        "ssn": lambda: _valid_ssn(value.replace("-", "")),
        "phone": lambda: 9 <= len(re.sub(r"\D", "", value)) <= 15,
    }.get(kind, lambda: True)()
    return kind if good else None


_TYPE = "struct<text:string,found:array<struct<kind:string,start:long,end:long>>>"


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> Column:
    """struct(text, found) per text: the text with pseudonyms, and what was found where in the text given, in characters.

    A null text stays null, an empty one empty, both with nothing found. With ``back`` pseudonyms become values again.
    """

    @F.arrow_udf(_TYPE)
    def changed(column: pa.Array) -> pa.Array:
        pseudonyms = Pseudonyms(key)
        rows = [pseudonyms.text(t, back) for t in column.to_pylist()]
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in rows]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array(found, kind)], ["text", "found"])

    return changed(docs[text])
