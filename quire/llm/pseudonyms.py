"""Format-preserving Feistel pseudonyms for personal data.

A detected value is validated (check digits, octets, calendar), read as a
number below the count of values of its format, and permuted under a key by a
Feistel network with cycle walking. The pseudonym keeps the format: separators,
letter case, check digits and calendar validity. The same value has the same
pseudonym in every document, different values have different ones, and no value
is its own pseudonym (the permutation is a conjugate of "add one", which has no
fixed point). Holders of the key can invert it.

Found are: emails (the domain is kept); phone numbers with a country code, with
an area code in brackets, in groups of 3-3-4, or of 7 to 15 digits behind a word
such as "phone"; card numbers; IBANs; IPv4 and IPv6 addresses; social security
numbers; dates in figures and with English month names; values named password,
token or key, the body of PEM private keys, JSON web tokens, and keys of known
or hexadecimal form. Not covered are names, postal addresses and bare digits
that no check tells from other numbers. Equal values in equal notation stay
linked; a date or an IPv6 address written in two ways has two pseudonyms.

Texts are scanned whole, row by row, in the task that reads them; nothing is
shuffled. The time is linear in a text: emails are read backwards from their
``@``, and values of more than ``BLOCK`` letters and digits are permuted block by
block, each under a tweak that the blocks before it decide (so two long values
that begin alike have pseudonyms that begin alike).

Defined cases: a null text stays null with no finds; texts without finds come
back unchanged; repeated rows are treated alike; an empty table gives an empty
result; unnamed columns are ignored or, where carried, pass through unread; a
carried column named ``text`` or ``found`` is returned as ``text_in`` or
``found_in``.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.runtime import by_bytes

ROUNDS = 8
#: Stands in where no key is given; production passes its own secret.
DEFAULT_KEY = b"set your own key"

#: Letters and digits that are permuted together.
BLOCK = 64
#: Values up to this length are remembered.
REMEMBERED_LENGTH = 200

KINDS = ("email", "phone", "card", "iban", "ip", "ssn", "date", "secret")

#: English month names; the first three letters are short forms.
MONTHS = "January February March April May June July August September October November December".split()

_PATTERN = re.compile(
    r"""
    (?P<secret>-----BEGIN\ [A-Z0-9 ]*PRIVATE\ KEY-----(?P<pem>[A-Za-z0-9+/=\s]{16,})-----END\ [A-Z0-9 ]*PRIVATE\ KEY-----
      |(?<![\w\-])eyJ(?P<jwt>[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})
      |(?P<name>\b(?:(?i:passw(?:or)?d|pwd|token|secret|api[_-]?key|access[_-]?key|auth[_-]?key))\s*[=:]\s*["']?)(?P<value>[^\s"',;]{6,})
      |\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|(?=[0-9a-f]*[0-9])[0-9a-f]{32,}|(?=[0-9A-F]*[0-9])[0-9A-F]{32,})\b)
    |(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<phone>(?<!\w)(?:\+[0-9]{1,3}[ ]?)?\([0-9]{3}\)[ ]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])
      |(?<!\w)\+[0-9]{1,3}(?:[ .\-][0-9]{2,4}){2,4}(?![0-9])
      |(?<!\w)\+[0-9]{8,15}(?![0-9])
      |(?<![\w.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9\-])
      |(?<![0-9.\-+][ ])(?<![\w.\-+])[2-9][0-9]{2}[ ][2-9][0-9]{2}[ ][0-9]{4}(?![ ]?[0-9]|[\-])
      |\b(?i:phone|tel|telephone|mobile|cell|fax|call|whatsapp)(?:[.:]|\ (?:no|number)\b[.:]?)?[ ]?(?P<bare>[0-9]{7,15})(?![0-9]))
    |(?P<ssn>(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-]))
    |(?P<date>(?<![\w/.\-])(?:[0-9]{4}(?P<bar>[\-/])[0-9]{2}(?P=bar)[0-9]{2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}
        |[0-9]{1,2}\ (?:MONTH)\ [0-9]{4}|\b(?:MONTH)\ [0-9]{1,2},?\ [0-9]{4})(?![\w/\-]))
    |(?P<ip>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)){1,7}(?::[0-9A-Fa-f]{1,4}){0,6}(?:[0-9A-Fa-f]{1,4})?(?![\w:])
      |(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<card>(?<![0-9])(?:[0-9]{4}(?P<sep>[ \-])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}|[0-9]{4}(?P<sep2>[ \-])[0-9]{6}(?P=sep2)[0-9]{5}|[0-9]{13,19})(?![0-9]))
    """.replace("MONTH", "|".join([*MONTHS, *(m[:3] for m in MONTHS if len(m) > 3)])),
    re.X,
)
#: What follows the name in an email, and the names that may stand before it.
_DOMAIN = re.compile(r"@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}")
_NAME_MARKS = frozenset(".%+-")
#: Characters of an IBAN, by country.
_IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: A text without any of these has nothing to find.
_HINT = re.compile("[0-9@=:]|sk-|gh[pousr]_|eyJ|-----BEGIN")


class Permuter:
    """Keyed permutations of ``range(size)`` without fixed points, apart from each other by ``tweak``."""

    def __init__(self, key: bytes):
        self.key = key

    def _mix(self, tweak: bytes, n: int, value: int, bound: int) -> int:
        width = (bound.bit_length() + 7) // 8 + 8
        seed = hashlib.blake2b(tweak + b"|%d|" % n + b"%x" % value, key=self.key[:64], digest_size=32).digest()
        return int.from_bytes(seed[:width] if width <= 32 else hashlib.shake_256(seed).digest(width), "big") % bound

    def _pass(self, tweak: bytes, size: int, x: int, back: bool) -> int:
        side = math.isqrt(size - 1) + 1
        while True:
            left, right = divmod(x, side)
            for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if n % 2:
                    right = (right + sign * self._mix(tweak, n, left, side)) % side
                else:
                    left = (left + sign * self._mix(tweak, n, right, side)) % side
            x = left * side + right
            if x < size:
                return x

    def permute(self, tweak: bytes, size: int, x: int, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        """The image of ``x``; with ``valid``, walks on to the next valid number of the cycle."""
        if size < 2:
            return x
        while True:
            x = self._pass(tweak, size, (self._pass(tweak, size, x, False) + (-1 if back else 1)) % size, True)
            if valid is None or valid(x):
                return x


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def iban_readings(match: str) -> list[str]:
    """What may be the IBAN in a match, which can have run on into the words behind it: first what has its country's length, then the longest."""
    ends = [len(match), *(i for i in range(len(match) - 1, 0, -1) if match[i] == " ")]
    readings = [match[:n] for n in ends]
    return sorted(readings, key=lambda x: len(x.replace(" ", "")) != _IBAN_LENGTHS.get(match[:2]))


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    fill = iter(digits)
    return "".join(next(fill) if c in "0123456789" else c for c in shape)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _is_hex(text: str, alphabet: str) -> bool:
    """Hexadecimal by sight: 8 characters or more, digits and letters."""
    return len(text) >= 8 and not set(text) - set(alphabet) and bool(re.search("[0-9]", text)) and bool(re.search("[A-Fa-f]", text))


class Pseudonyms:
    """Replaces detected values; ``back=True`` restores them."""

    def __init__(self, key: bytes = DEFAULT_KEY, back: bool = False):
        self.permuter, self.back = Permuter(key), back
        self._remembered = lru_cache(maxsize=50_000)(self._value)

    def value(self, kind: str, text: str) -> str | None:
        return (self._remembered if len(text) <= REMEMBERED_LENGTH else self._value)(kind, text)

    def _number(self, tweak: str, digits: str, valid: Callable[[str], bool] | None = None) -> str:
        n = len(digits)
        fits = valid and (lambda x: valid(f"{x:0{n}d}"))
        return f"{self.permuter.permute(f'{tweak}{n}'.encode(), 10**n, int(digits), self.back, fits):0{n}d}"

    def _letters(self, tweak: str, text: str, valid: Callable[[str], bool] | None = None) -> str:
        """Permutes ASCII letters and digits together, each within its own alphabet; long texts block by block."""
        plain = re.sub("[^0-9A-Za-z]", "", text)
        hexes = next((a for a in _HEX if tweak == "secret" and _is_hex(plain, a)), None)
        kinds = [hexes or next(a for a in _ALPHABETS if c in a) for c in plain]
        # what is read back must fall into the same alphabets
        kept = lambda new: _is_hex(new, hexes) if hexes else tweak != "secret" or not any(_is_hex(new, a) for a in _HEX)
        same = lambda new: kept(new) and (valid is None or valid(new))
        if len(plain) <= BLOCK:
            new = self._block(tweak, plain, kinds, same)
        else:
            new = self._blocks(tweak, plain, kinds)
            while not same(new):
                new = self._blocks(tweak, new, kinds)
        fill = iter(new)
        return "".join(next(fill) if re.match("[0-9A-Za-z]", c) else c for c in text)

    def _blocks(self, tweak: str, plain: str, kinds: list[str]) -> str:
        """One pass over a long text; a block's tweak holds the hash of the clear blocks before it."""
        out, chain = [], hashlib.blake2b(digest_size=16)
        for lo in range(0, len(plain), BLOCK):
            own = plain[lo : lo + BLOCK]
            new = self._block(f"{tweak}|{lo}|{chain.hexdigest()}|", own, kinds[lo : lo + BLOCK])
            chain.update((new if self.back else own).encode())
            out.append(new)
        return "".join(out)

    def _block(self, tweak: str, plain: str, kinds: list[str], valid: Callable[[str], bool] | None = None) -> str:
        size, x = 1, 0
        for c, a in zip(plain, kinds, strict=True):
            size, x = size * len(a), x * len(a) + a.index(c)
        shape = "".join("x" if a in _HEX else a[0] for a in kinds)

        def spelled(y: int) -> str:
            out = []
            for a in reversed(kinds):
                y, r = divmod(y, len(a))
                out.append(a[r])
            return "".join(reversed(out))

        return spelled(self.permuter.permute(f"{tweak}{shape}".encode(), size, x, self.back, valid and (lambda y: valid(spelled(y)))))

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where the value fails its validation."""
        digits = re.sub("[^0-9]", "", text)
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            payload = self._number("card", digits[:-1], lambda p: len(set(p + luhn_digit(p))) > 1)
            return _refill(text, payload + luhn_digit(payload))
        if kind == "iban":
            reading = next((x for x in iban_readings(text) if _is_iban(x)), None)
            if reading is None:
                return None
            plain, behind = reading.replace(" ", ""), text[len(reading) :]

            def filled(rest: str) -> str:
                fill = iter(plain[:2] + iban_check(plain[:2], rest) + rest)
                return "".join(c if c == " " else next(fill) for c in reading)

            def read_alike(rest: str) -> bool:
                """Whether the pseudonym, with what is behind it, is read at the same length."""
                return len(next(x for x in iban_readings(filled(rest) + behind) if _is_iban(x))) == len(reading)

            return filled(self._letters("iban", plain[4:], read_alike if behind else None))
        if kind == "phone":
            if not 7 <= len(digits) <= 15:
                return None
            code = re.match(r"\+[0-9]{1,3}(?=[ .\-(])|\+[0-9]", text)
            keep = len(code[0]) if code else 0
            # groups with spaces alone are known by their first figures
            spaced = re.fullmatch("[0-9]{3} [0-9]{3} [0-9]{4}", text)
            return text[:keep] + _refill(text[keep:], self._number("phone spaced" if spaced else "phone", digits[max(keep - 1, 0) :], (lambda d: d[0] > "1" and d[3] > "1") if spaced else None))
        if kind == "ssn":
            good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
            return _refill(text, self._number("ssn", digits, good)) if good(digits) else None
        if kind == "ip" and ":" in text:
            return self._ipv6(text)
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            if max(octets) > 255 or ".".join(map(str, octets)) != text:
                return None
            x = self.permuter.permute(b"ip", 1 << 32, int.from_bytes(bytes(octets), "big"), self.back)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "date":
            return self._date(text)
        if kind == "email":
            local, _, domain = text.rpartition("@")
            return f"{self._letters('email', local)}@{domain}"
        kept = re.match("AKIA|gh[pousr]_|sk-", text)
        at = kept.end() if kept else 0
        return text[:at] + self._letters("secret", text[at:])

    def _ipv6(self, text: str) -> str | None:
        """Permutes the hexadecimal digits of an address with three groups or more, each in its place."""
        groups = text.split(":")
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        if sum(map(bool, groups)) < 3:
            return None
        digits, upper = text.replace(":", ""), text != text.lower()
        # the case of an address is that of its letters; figures alone stay figures or turn into small letters
        if upper and text != text.upper():
            return None
        y = self.permuter.permute(f"ipv6{upper}{[len(g) for g in groups]}".encode(), 16 ** len(digits), int(digits, 16), self.back, lambda x: not upper or not f"{x:x}".isdigit())
        fill = iter(f"{y:0{len(digits)}{'X' if upper else 'x'}}")
        return "".join(":" if c == ":" else next(fill) for c in text)

    def _worded_date(self, text: str) -> str | None:
        """A date with the name of its month: the same order, name length and zero before the day."""
        parts = re.split(r"([ ,]+)", text)
        d, m = (0, 2) if parts[0][0] in "0123456789" else (2, 0)
        short, zero = len(parts[m]) == 3 and parts[m] != "May", parts[d][0] == "0"
        try:
            day = datetime.date(int(parts[4]), 1 + next(i for i, x in enumerate(MONTHS) if x.startswith(parts[m])), int(parts[d]))
        except ValueError:
            return None
        # short forms do not fall on May, which is no shorter; a zero stays before a single figure
        fits = lambda x: not (short and x.month == 5) and not (zero and x.day > 9)
        new = self._moved_day(day, f"named{short}{zero}", fits)
        parts[4], parts[m], parts[d] = f"{new.year:04d}", MONTHS[new.month - 1][: 3 if short else None], f"{new.day:02d}" if zero else str(new.day)
        return "".join(parts)

    def _moved_day(self, day: datetime.date, tweak: str, fits: Callable[[datetime.date], bool]) -> datetime.date:
        """The day's image among those that fit, of its 200 years (1900-2099 and so on)."""
        first = max(1, (day.year - 1900) // 200 * 200 + 1900)
        low, high = datetime.date(first, 1, 1).toordinal(), datetime.date(min((day.year - 1900) // 200 * 200 + 2099, 9999), 12, 31).toordinal()
        return datetime.date.fromordinal(low + self.permuter.permute(f"date{first}{tweak}".encode(), high - low + 1, day.toordinal() - low, self.back, lambda x: fits(datetime.date.fromordinal(low + x))))

    def _date(self, text: str) -> str | None:
        """A date in figures."""
        if re.search("[A-Z]", text):
            return self._worded_date(text)
        parts = re.split(r"([/.\-])", text)
        orders = ((0, 2, 4),) if len(parts[0]) == 4 else ((4, 2, 0), (4, 0, 2))
        for y, m, d in orders:
            try:
                day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d]))
            except ValueError:
                continue
            wide = {i: len(parts[i]) == 2 for i in (m, d)}
            fits = lambda x: self._same_reading(x, orders, (y, m, d), wide)  # noqa: B023, E731
            if not fits(day):
                return None
            new = self._moved_day(day, f"{(y, m, d)}{sorted(wide.items())}", fits)
            out = list(parts)
            out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:02d}" if wide[m] else str(new.month), f"{new.day:02d}" if wide[d] else str(new.day)
            return "".join(out)
        return None

    @staticmethod
    def _same_reading(day: datetime.date, orders, order, wide) -> bool:
        """Whether the pseudonym keeps the field widths and is read in the same order of fields."""
        if any(not w and n > 9 for w, n in ((wide[order[1]], day.month), (wide[order[2]], day.day))):
            return False
        return order == orders[0] or day.day > 12

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text and (kind, start, length) of each replaced value, in characters of the old text."""
        found: list[tuple[str, int, int]] = []
        if not _HINT.search(text):
            return text, found

        out, at = [], 0
        emails = _emails(text)
        email, m = next(emails, None), _PATTERN.search(text)
        while True:
            if m is not None and m.start() < at:
                m = _PATTERN.search(text, at)
            while email is not None and (name := _name_start(text, max(at, email[0]), email[1])) is None:
                email = next(emails, None)
            if email is not None and (m is None or name < m.start() or name == m.start() and m["secret"] is None):
                kind, start, value, end = "email", name, text[name : email[2]], email[2]
            elif m is not None:
                kind = next(k for k in KINDS if k != "email" and m[k] is not None)
                part = next((p for p in ("value", "pem", "jwt", "bare") if m[p] is not None), 0)
                start, value, end = m.start(part), m[part], m.end()
            else:
                break
            new = self.value(kind, value)
            if new is None or new == value:
                out.append(text[at:end])
                at = end
                continue
            if kind == "iban":
                # what follows the IBAN in the match is searched in its turn
                value = value[: len(new)]
            found.append((kind, start, len(value)))
            out += [text[at:start], new]
            at = start + len(value)
        return "".join(out) + text[at:], found


def _emails(text: str):
    """(begin of the run of name characters, place of the ``@``, end) of what may be emails, in order."""
    for m in _DOMAIN.finditer(text):
        begin = m.start()
        while begin and (text[begin - 1] in _NAME_MARKS or text[begin - 1] == "_" or text[begin - 1].isalnum()):
            begin -= 1
        if begin < m.start():
            yield begin, m.start(), m.end()


def _name_start(text: str, low: int, at: int) -> int | None:
    """The first letter or digit of a name that ends before ``at``."""
    while low < at and text[low] in _NAME_MARKS:
        low += 1
    return low if low < at else None


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """The carried columns, the new ``text`` and ``found``: array of (kind, start, length)."""
    inputs = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*inputs.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("found", T._parse_datatype_string("array<struct<kind:string,start:int,length:int>>"))])

    def swap(batches):
        import pyarrow as pa

        names = Pseudonyms(key, back)
        finds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            for part in by_bytes(batch, 0):
                out = [(None, []) if x is None else names.replace(x) for x in part.column(0).to_pylist()]
                found = [[{"kind": k, "start": s, "length": n} for k, s, n in f] for _, f in out]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([t for t, _ in out], pa.string()), pa.array(found, finds)], names=[*part.schema.names[1:], "text", "found"])

    return inputs.mapInArrow(swap, schema).withColumnsRenamed({f"_c{i}": f"{c}_in" if c in ("text", "found") else c for i, c in enumerate(carry)})


def op5_pii(spark, sf_dir):
    found = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(found, f -> f.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", "text", *counts)
