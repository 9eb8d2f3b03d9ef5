"""Format-preserving pseudonyms for personal data by keyed Feistel networks.

A value that passes its kind's validation is replaced by another valid value of
the same format. The replacement is a permutation of the kind's values under
the key, so equal values stay equal in every document, different ones stay
different, and the holder of the key can undo it. Black and Rogaway, "Ciphers
with arbitrary finite domains".
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import free_names, with_fields
from .text import small_batches

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points.

    A Feistel network alternates over two parts of the number, (l + f(r)) mod a and (r + f(l)) mod b;
    where n is less than a * b, values outside are walked through until one is inside. Of this
    permutation p, the pseudonym is p'(p(x) + 1): a permutation too, and never x itself.
    """

    def __init__(self, key: bytes, kind: str, a: int, b: int, n: int | None = None):
        self.a, self.b, self.n = a, b, n or a * b
        self.seed = len(key).to_bytes(2, "big") + key + kind.encode() + b"\0%d,%d,%d\0" % (a, b, self.n)
        self.width = max(a, b).bit_length() // 8 + 9

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.shake_256(self.seed + b"%d:%d" % (i, x)).digest(self.width), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(0, ROUNDS, 2):
            left = (left + self._f(i, right)) % self.a
            right = (right + self._f(i + 1, left)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(i + 1, left)) % self.b
            left = (left - self._f(i, right)) % self.a
        return left * self.b + right

    def _walk(self, x: int, step: Callable[[int], int]) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def apply(self, x: int, by: int = 1) -> int:
        """The pseudonym of x; with ``by`` -1, the value of which x is the pseudonym."""
        return self._walk((self._walk(x, self._once) + by) % self.n, self._back)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


#: First digits by which card networks are told, from and to, and the lengths of their numbers.
NETWORKS = [
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)),
    ("3528", "3589", (16, 17, 18, 19)), ("300", "305", (14, 16, 19)), ("36", "36", (14, 16, 19)), ("38", "39", (14, 16, 19)), ("62", "62", (16, 17, 18, 19)),
    ("5018", "5018", (13, 14, 15, 16, 17, 18, 19)), ("5020", "5020", (13, 14, 15, 16, 17, 18, 19)), ("5038", "5038", (13, 14, 15, 16, 17, 18, 19)), ("6304", "6304", (13, 14, 15, 16, 17, 18, 19)),
    ("6759", "6759", (13, 14, 15, 16, 17, 18, 19)), ("676", "676", (13, 14, 15, 16, 17, 18, 19)),
]


def network(digits: str) -> int:
    """How many first digits tell the network of a card number; 0 if none does."""
    return next((len(low) for low, high, lengths in NETWORKS if low <= digits[: len(low)] <= high and len(digits) in lengths), 0)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


DAY0, DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days

#: Only a day above 12 shows that a month stands first, so such days and the others are permuted among themselves, however they are written.
_ALL = [DAY0 + dt.timedelta(i) for i in range(DAYS)]
EARLY, LATE = [d for d in _ALL if d.day <= 12], [d for d in _ALL if d.day > 12]
PLACE = {d: i for own in (EARLY, LATE) for i, d in enumerate(own)}


#: Length of an IBAN by country: where groups are spaced, it tells where the number ends.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
SPACED_IBAN = "|".join(
    rf"(?:{'|'.join(names.split())})\d\d(?:[ ][A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"[ ][A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_LENGTHS.items()
)


#: What makes four numbers with dots a version.
NUMBERED = re.compile(r"(?i)(?<![a-z])(?:v|ver|version|release|rev|build)\.?[ ]?\Z")


class Pseudonyms:
    """Finds and replaces the personal data of texts under one key; ``by`` -1 undoes it."""

    KINDS = ("email", "secret", "iban", "card", "date", "ssn", "phone", "ip")
    #: Every alternative starts where no character of its kind comes before, and repeats within limits: time stays linear.
    PATTERN = re.compile(
        rf"""(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{{1,64}}@(?:[A-Za-z0-9\-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9]))
        |(?P<lead>(?i:(?<![a-z])(?:token|secret|passw(?:or)?d|api[_\- ]?key|access[_\- ]?key)[ ]?[:=][ ]?["']?))(?P<secret>[A-Za-z0-9_\-]{{16,128}})(?![A-Za-z0-9_\-])
        |(?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}(?![A-Za-z0-9]))
        |(?P<iban2>(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d\d[ ])(?:{SPACED_IBAN})(?![A-Za-z0-9]))
        |(?<!\d)(?<!\d[.\-])(?:
          (?P<card>\d{{13,19}}|\d{{4}}(?P<sep>[ \-])\d{{4}}(?P=sep)\d{{4}}(?P=sep)\d{{4}}|\d{{4}}(?P<sep2>[ \-])\d{{6}}(?P=sep2)\d{{5}})
          |(?P<date>(?:19|20)\d\d(?P<dash>[\-/.])\d\d(?P=dash)\d\d|\d\d(?P<slash>[\-/.])\d\d(?P=slash)(?:19|20)\d\d)
          |(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})
          |(?P<phone4>1[\-. ]\d{{3}}[\-. ]\d{{3}}[\-. ]\d{{4}})
          |(?P<phone2>\d{{3}}[\-. ]\d{{3}}[\-. ]\d{{4}})
          |(?P<ip>\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})
        )(?!\d)(?![.\-]\d)
        |(?P<phone5>(?<![\w+])\+1[ .\-]?(?:\(\d{{3}}\)|\d{{3}})[ .\-]?\d{{3}}[ .\-]?\d{{4}}(?!\d))
        |(?P<phone>(?<![\w+])\+\d{{1,3}}[ .\-]?(?:\(\d{{2,4}}\)[ .\-]?)?\d{{2,4}}(?:(?:[ \-]?\d{{2,4}}){{1,4}}|(?:\.\d{{2,4}}){{1,4}})(?!\d)(?!\.\d))
        |(?P<phone3>\(\d{{3}}\)[ ]?\d{{3}}[\-. ]\d{{4}}(?!\d))""",
        re.VERBOSE | re.ASCII,
    )
    HINT = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")

    def __init__(self, key: bytes, by: int = 1):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.by = key, by
        self.permutations: dict[tuple, Permutation] = {}
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, kind: str, x: int, a: int, b: int, n: int | None = None) -> int:
        at = (kind, a, b, n)
        if at not in self.permutations:
            if len(self.permutations) > 10_000:
                self.permutations.clear()
            self.permutations[at] = Permutation(self.key, kind, a, b, n)
        return self.permutations[at].apply(x, self.by)

    def characters(self, kind: str, value: str, hexadecimal: bool = False) -> str:
        """Letters and digits permuted among their own classes, the case of every place and all other characters kept."""
        places = [i for i, c in enumerate(value) if c.isascii() and c.isalnum()]
        low = [value[i].lower() for i in places]
        radix = [16 if hexadecimal else 10 if c.isdigit() else 26 for c in low]
        half = len(places) // 2
        number, sizes = 0, [1, 1]
        for k, (c, r) in enumerate(zip(low, radix, strict=True)):
            number = number * r + (int(c, 16) if r < 26 else ord(c) - 97)
            sizes[k >= half] *= r
        shape = "".join("hdl"[[16, 10, 26].index(r)] for r in radix)
        number = self._permute(f"{kind}:{shape}", number, *sizes)
        out = list(value)
        # hexadecimal letters take the case that the value's letters have
        raised = value.isupper() if hexadecimal else False
        for i, r in zip(reversed(places), reversed(radix), strict=True):
            number, d = divmod(number, r)
            c = "0123456789abcdef"[d] if r < 26 else chr(97 + d)
            out[i] = c.upper() if raised or (not hexadecimal and value[i].isupper()) else c
        return "".join(out)

    def _digits(self, kind: str, value: str, keep: int = 0) -> str:
        own = [i for i, c in enumerate(value) if c.isdigit()][keep:]
        n = len(own)
        number = self._permute(f"{kind}:{n}", int("".join(value[i] for i in own)), 10 ** (n // 2), 10 ** (n - n // 2))
        out = list(value)
        for i, c in zip(own, str(number).zfill(n), strict=True):
            out[i] = c
        return "".join(out)

    def email(self, value: str) -> str | None:
        name, _, top = value.rpartition(".")
        return f"{self.characters('email', name)}.{top}"

    def secret(self, value: str) -> str | None:
        if not any(map(str.isdigit, value)):
            return None
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None
        return self.characters("secret", value, hexadecimal)

    def card(self, value: str) -> str | None:
        own = [i for i, c in enumerate(value) if c.isdigit()]
        digits = "".join(value[i] for i in own)
        kept = network(digits)
        if not kept or not luhn(digits):
            return None
        head, n = digits[:kept], len(digits) - 1 - kept
        number = self._permute(f"card:{head}:{n}", int(digits[kept:-1]), 10 ** (n // 2), 10 ** (n - n // 2))
        body = head + str(number).zfill(n)
        body += next(c for c in "0123456789" if luhn(body + c))
        out = list(value)
        for i, c in zip(own, body, strict=True):
            out[i] = c
        return "".join(out)

    def iban(self, value: str) -> str | None:
        if _mod97(value) != 1:
            return None
        country, rest = value[:2], self.characters("iban" + value[:2], value[4:])
        return f"{country}{98 - _mod97(f'{country}00{rest}'):02d}{rest}"

    def iban2(self, value: str) -> str | None:
        new = self.iban(value.replace(" ", ""))
        return new and " ".join(new[i : i + 4] for i in range(0, len(new), 4))

    def date(self, value: str) -> str | None:
        first = value[4] in "-/."
        sep = value[4 if first else 2]
        a, b, c = map(int, value.split(sep))
        year, month, day = (a, b, c) if first else (c, b, a)
        swapped = not first and month > 12
        if swapped:
            month, day = day, month
        try:
            own = dt.date(year, month, day)
        except ValueError:
            return None
        if own.day > 12:
            new = LATE[self._permute("late date", PLACE[own], 211, 210, len(LATE))]
        else:
            new = EARLY[self._permute("early date", PLACE[own], 170, 170, len(EARLY))]
        if swapped:
            return f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year}"
        return f"{new.year}{sep}{new.month:02d}{sep}{new.day:02d}" if first else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}"

    def ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        number, serial = divmod(self._permute("ssn", number, 898, 99 * 9999), 9999)
        area, group = divmod(number, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, value: str) -> str | None:
        if not 8 <= sum(map(str.isdigit, value)) <= 15:
            return None
        country = re.match(r"\+(\d{1,3})(?=[ .\-(])", value)
        return self._digits("phone", value, len(country[1]) if country else 1 if value[0] == "+" else 0)

    phone2 = phone3 = phone5 = phone

    def _shorter(self, value: str) -> int:
        """Where a telephone number with too many digits ends, by whole groups; 0 if nowhere."""
        ends = [m.start() for m in re.finditer(r"[ .\-]", value)]
        return next((end for end in reversed(ends) if self.phone(value[:end])), 0)

    def phone4(self, value: str) -> str | None:
        """With the country's 1 in front: the same pseudonym as without."""
        return value[:2] + self.phone(value[2:])

    def ip(self, value: str) -> str | None:
        """Four octets; after a word such as version they are none, see ``replace``."""
        octets = value.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        number = int.from_bytes(bytes(map(int, octets)), "big")
        return ".".join(map(str, self._permute("ip", number, 1 << 16, 1 << 16).to_bytes(4, "big")))

    def replace(self, text: str | None) -> tuple[str | None, Counter]:
        """The text with pseudonyms, and how many of each kind it holds."""
        found: Counter = Counter()
        if not text or not self.HINT.search(text):
            return text, found

        def new(m: re.Match) -> str:
            kind = m.lastgroup if m.lastgroup not in ("sep", "sep2", "dash", "slash", "lead") else next(k for k in ("card", "date") if m[k])
            value = m[kind]
            at = (kind, value)
            if at not in self.known:
                if len(self.known) > 20_000:
                    self.known.clear()
                self.known[at] = getattr(self, kind)(value)
            out = self.known[at]
            if out is None and kind == "iban2":  # what only looks like one may hold other values in its groups
                rest, more = self.replace(value[5:])
                found.update(more)
                return value[:5] + rest
            if out is None and kind == "phone" and (end := self._shorter(value)):  # a telephone number with another number behind it
                rest, more = self.replace(value[end:])
                found.update(more)
                found["phone"] += 1
                return self.phone(value[:end]) + rest
            if out is None or kind == "ip" and NUMBERED.search(text, max(0, m.start() - 12), m.start()):
                return m[0]
            found[kind.rstrip("2345")] += 1
            return (m["lead"] or "") + out

        return self.PATTERN.sub(new, text), found


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", undo: bool = False) -> tuple[DataFrame, list[str]]:
    """docs with the personal data of ``text_col`` replaced, and a count of each kind in columns whose names are returned too.

    Kinds: e-mail addresses; secrets after a word that announces them; IBANs
    (mod 97), payment cards (first digits of a network, its length, Luhn),
    calendar dates from 1900 to 2099, US social security numbers, telephone
    numbers and IPv4 addresses, unless a word such as version stands before
    them. A card keeps the digits of its network, a date whether its day is
    above 12: so one day stays one in every notation. Values may
    follow a digit and a comma, as in lists and CSV; a digit and a dot or dash
    before a number, or a dot or dash and a digit after it, make it part of a
    longer one, which is none of these kinds. IBANs may be spaced in fours.
    What looks like one of them but fails its validation stays as it is. Null and empty
    texts stay null and empty; all other columns and all rows pass through, and
    the names of the new columns step aside for columns of the same name.
    ``undo`` with the same key brings the texts back: a pseudonym is as valid
    as the value it stands for.

    Each text is read where it lies: no shuffle, and memory of one batch.
    """
    small_batches(docs.sparkSession)
    names = free_names(docs.columns, *(f"n_{k}" for k in Pseudonyms.KINDS))
    at = docs.columns.index(text_col)
    columns, by = docs.columns, -1 if undo else 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, by)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(at).to_pylist():
                new, found = own.replace(text)
                texts.append(new)
                counts.append([found[k] for k in Pseudonyms.KINDS])
            out = list(batch.columns)
            out[at] = pa.array(texts, pa.string())
            extra = [pa.array(x, pa.int32()) for x in zip(*counts, strict=True)] if counts else [pa.array([], pa.int32())] * len(names)
            yield pa.RecordBatch.from_arrays([*out, *extra], names=[*columns, *names])

    return docs.mapInArrow(scan, with_fields(docs.schema, **{n: T.IntegerType() for n in names})), names
