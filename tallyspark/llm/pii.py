"""Format-preserving pseudonyms: validated numbers, dates and addresses, keyed Feistel.

A value found in a text is checked (Luhn, mod 97, calendar, octets), ranked among all valid
values of its format, permuted there, and written back with its own separators, so it stays
valid and equal values stay linked across documents and spellings. The permutation is
``P^-1(P(x) + s mod N)`` with a keyed Feistel network ``P`` walked inside the format and a
keyed shift ``s``: no value is its own pseudonym.

==========  =======================================================  =====================
kind        found and checked                                        kept
==========  =======================================================  =====================
email       address with a dotted domain                             shape, last label
iban        country, mod 97                                          country, letters' places
date        ISO, year/month/day, day/month/year, day.month.year      spelling; the span of
            (also two-digit years), English month name, ordinals     years; day above 12
card        13 to 19 digits, plain or grouped, Luhn                  first digit, Luhn
ssn         AAA-GG-SSSS in the valid ranges                          the ranges
ip          four octets up to 255                                    four octets
phone       ``+`` and 8 to 15 digits, (AAA) EEE-NNNN, AAA-EEE-NNNN   country code, (0)
==========  =======================================================  =====================

Spans of years are 1 to 999, to 1899, to 1929, to 2029, to 2099 and later; two-digit years are
1930 to 2029, so they are a span of their own. Days up to 12 and above are permuted apart, as a
number above 12 tells which part of a date is the day. So a date has one pseudonym in all its
spellings and no two dates share one. Country codes are cut by the numbering plan.

Numbers that fail their check are no such value and stay. Texts without a digit or an ``@``
are not searched. One pass by Arrow batches; nothing is shuffled.

Defined cases: null and empty texts stay as they are; repeated rows get equal results; all
other columns pass through unread.
"""

import datetime as dt
import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.common import ship

ROUNDS = 8

# Month names, and days that dates are permuted among.
MONTHS = ("january february march april may june july august september october november "
          "december").split()
SPANS = [(kind, dt.date(first, 1, 1).toordinal(), dt.date(last, 12, 31).toordinal())
         for kind, first, last in (("date first", 1, 999), ("date early", 1000, 1899),
                                   ("date before", 1900, 1929), ("date", 1930, 2029),
                                   ("date after", 2030, 2099), ("date late", 2100, 9999))]
PIVOT = 30  # two-digit years from here on are of the 1900s: 1930 to 2029

# Country codes of one and two digits in the public numbering plan; all others
# have three.
SHORT_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 "
                  "58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

#: Lengths of IBANs by country.
IBAN_SIZES = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 "
    "EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
    "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 "
    "TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}

START, STOP = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_NAMES = "|".join(MONTHS + ["sept"] + [m[:3] for m in MONTHS])
_TH = "(?:st|nd|rd|th)?"
EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@"
                   r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII)
IBAN = re.compile(START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + STOP)
DATES = [
    (re.compile(START + r"([0-9]{4})([-/.])([0-9]{1,2})(\2)([0-9]{1,2})"
                rf"(?:(?=[Tt][0-9]{{2}})|{STOP})"), "ymd"),
    (re.compile(START + r"([0-9]{1,2})([/.-])([0-9]{1,2})(\2)([0-9]{4})"
                rf"(?:(?=[Tt][0-9]{{2}})|{STOP})"), "dmy"),
    (re.compile(START + rf"([0-9]{{1,2}})({_TH}(?: (?:of )?|-))({_NAMES})(\.?,? |-)([0-9]{{4}})"
                + STOP, re.I), "dmy"),
    (re.compile(START + rf"({_NAMES})(\.? )([0-9]{{1,2}})({_TH},? )([0-9]{{4}})" + STOP, re.I),
     "mdy"),
]
#: Looked for last: parts of other values look like it.
SHORT_DATE = re.compile(r"(?<![0-9A-Za-z./+-])([0-9]{1,2})([/.-])([0-9]{1,2})(\2)([0-9]{2})"
                        r"(?![./-]?[0-9A-Za-z])")
CARD = re.compile(START + r"(?:[0-9]{13,19}"
                  r"|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?"
                  r"|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})" + STOP)
SSN = re.compile(START + r"([0-9]{3})-([0-9]{2})-([0-9]{4})" + STOP)
IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])")
PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
                   r"|[0-9]{3}(?P<mark>[.-])[0-9]{3}(?P=mark)[0-9]{4}"
                   r"|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
                   r"|\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?!\)))" + STOP)


class Permuter:
    """Keyed permutations of 0..N-1, one for each kind and N."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permute = lru_cache(100_000)(self._permute)

    def _round(self, kind: bytes, n: int, k: int, half: int, bits: int) -> int:
        data = b"%s|%d|%d|%d" % (kind, n, k, half)
        digest = hashlib.blake2b(data, key=self.key, digest_size=(bits + 7) // 8 + 8).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _feistel(self, kind: bytes, n: int, x: int, back: bool) -> int:
        bits = max((n - 1).bit_length() + 1, 2) // 2
        while True:  # a value outside 0..n-1 is walked on until it is inside again
            left, right = x >> bits, x & ((1 << bits) - 1)
            for k in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)):
                if back:
                    left, right = right ^ self._round(kind, n, k, left, bits), left
                else:
                    left, right = right, left ^ self._round(kind, n, k, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def _permute(self, kind: str, n: int, x: int) -> int:
        if n < 2:
            return x
        name = kind.encode()
        shift = 1 + self._round(name, n, ROUNDS, 0, 128) % (n - 1)
        return self._feistel(name, n, (self._feistel(name, n, x, False) + shift) % n, True)


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    following = iter(digits)
    return "".join(next(following) if c.isdigit() else c for c in shape)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def email(p: Permuter, m) -> str:
    whole = m.group()
    stem, dot, last = whole.rpartition(".")
    rank, n, sizes = 0, 1, []
    for c in stem.lower():  # the spelling's case is kept, so it doesn't count
        base = 26 if c.isalpha() else 10 if c.isdigit() else 1
        rank = rank * base + (ord(c) - 97 if base == 26 else int(c) if base == 10 else 0)
        n *= base
        sizes.append(base)
    rank, out = p.permute("email", n, rank), []
    for c, base in zip(reversed(stem), reversed(sizes)):
        rank, digit = divmod(rank, base)
        new = chr(97 + digit) if base == 26 else str(digit) if base == 10 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out)) + dot + last


def iban(p: Permuter, m) -> str | None:
    whole = m.group().replace(" ", "")

    def rest(s):
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    body = "".join(c for c in whole[4:] if c.isdigit())
    if not 15 <= len(whole) <= 34 or rest(whole) != 1 or not body:
        return None
    new = str(p.permute("iban", 10 ** len(body), int(body))).zfill(len(body))
    new = whole[:2] + "00" + refill(whole[4:], new)
    new = new[:2] + f"{98 - rest(new):02d}" + new[4:]
    following = iter(new)
    return "".join(c if c == " " else next(following) for c in m.group())


@lru_cache(None)
def days(first: int, last: int, late: bool) -> np.ndarray:
    """Ordinals from ``first`` to ``last`` whose day of the month is above 12, or not."""
    number = np.arange(first, last + 1)
    day = (number - 719163).astype("M8[D]")  # 719163: 1 January 1970
    of_month = (day - day.astype("M8[M]")).astype(int) + 1
    return number[(of_month > 12) == late].astype("i4")


def date(p: Permuter, m, order: str) -> str | None:
    parts = {order[0]: m.group(1), order[1]: m.group(3), order[2]: m.group(5)}
    named = not parts["m"].isdigit()
    month = [x[:3] for x in MONTHS].index(parts["m"][:3].lower()) + 1 if named else int(parts["m"])
    year, day = int(parts["y"]), int(parts["d"])
    short = len(parts["y"]) == 2
    if short:
        year += 1900 if year >= PIVOT else 2000
    swapped = month > 12 and order == "dmy" and not named  # month first
    if swapped:
        day, month = month, day
    try:
        number = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    kind, first, last = next(x for x in SPANS if x[1] <= number <= x[2])
    among = days(first, last, day > 12)
    rank = p.permute(f"{kind} {day > 12}", len(among), int(np.searchsorted(among, number)))
    new = dt.date.fromordinal(int(among[rank]))
    d, mo = (new.month, new.day) if swapped else (new.day, new.month)
    if named:
        old = parts["m"]
        text = MONTHS[new.month - 1]
        text = text[:3] if len(old) == 3 or old.lower() == "sept" else text
        shown = (text.upper() if old.isupper() else text.capitalize() if old[0].isupper()
                 else text)
    else:
        shown = str(mo).zfill(len(parts["m"]))
    year = f"{new.year % 100:02d}" if short else f"{new.year:04d}"
    out = {"y": year, "m": shown, "d": str(d).zfill(len(parts["d"]))}
    gaps = [m.group(2), m.group(4)]
    k = order.index("d")
    if k < 2 and (th := re.match("st|nd|rd|th", gaps[k], re.I)):
        end = "th" if d in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")
        gaps[k] = (end.upper() if th.group().isupper() else end) + gaps[k][2:]
    return out[order[0]] + gaps[0] + out[order[1]] + gaps[1] + out[order[2]]


def card(p: Permuter, m) -> str | None:
    digits = "".join(c for c in m.group() if c.isdigit())
    if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    size = len(digits) - 2
    body = digits[0] + str(p.permute("card" + digits[0], 10 ** size, int(digits[1:-1]))).zfill(size)
    return refill(m.group(), body + luhn_digit(body))


def ssn(p: Permuter, m) -> str | None:
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = (int(x) for x in m.groups())
    if area not in areas or not group or not serial:
        return None
    rank = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    rank = p.permute("ssn", len(areas) * 99 * 9999, rank)
    rank, serial = divmod(rank, 9999)
    return f"{areas[rank // 99]:03d}-{rank % 99 + 1:02d}-{serial + 1:04d}"


def ip(p: Permuter, m) -> str | None:
    octets = [int(x) for x in m.group().split(".")]
    if max(octets) > 255:
        return None
    new = p.permute("ip", 2 ** 32, int.from_bytes(bytes(octets), "big"))
    return ".".join(map(str, new.to_bytes(4, "big")))


def phone(p: Permuter, m) -> str | None:
    whole, cut = m.group(), 0
    if whole[0] == "+":
        at = [k for k, c in enumerate(whole) if c.isdigit()]
        code = next((n for n in (1, 2) if "".join(whole[k] for k in at[:n]) in SHORT_CODES), 3)
        cut = at[code - 1] + 1
        if trunk := re.match(r"[ .-]?\(0\)", whole[cut:]):  # dialled inside the country only
            cut += trunk.end()
    digits = "".join(c for c in whole[cut:] if c.isdigit())
    if not 5 <= len(digits) <= 14:
        return None
    new = str(p.permute("phone", 10 ** len(digits), int(digits))).zfill(len(digits))
    return whole[:cut] + refill(whole[cut:], new)


NUMBERS = [("iban", IBAN, iban),
           *[("date", pattern, (lambda o: lambda p, m: date(p, m, o))(order))
             for pattern, order in DATES],
           ("card", CARD, card), ("ssn", SSN, ssn), ("ip", IP, ip), ("phone", PHONE, phone),
           ("date", SHORT_DATE, lambda p, m: date(p, m, "dmy"))]


def iban_ends(m) -> list[int]:
    """Where the value may end: at its country's length, then as found; for unknown countries at
    each gap, from the last."""
    at = [k for k in range(m.start(), m.end()) if m.string[k] != " "]
    size = IBAN_SIZES.get(m.group()[:2])
    if size is None:
        gaps = [k for k in range(m.start(), m.end()) if m.string[k] == " "]
        return [m.end(), *reversed(gaps)]
    cut = at[size - 1] + 1 if len(at) >= size else m.end()
    whole = cut == m.end() or m.string[cut] == " "
    return [cut, m.end()] if whole and cut < m.end() else [m.end()]


def card_ends(m) -> list[int]:
    """As found, then without a last group of three digits."""
    shorter = re.search(r"[ -][0-9]{3}$", m.group())
    return [m.end(), *([m.start() + shorter.start()] if shorter else [])]


#: Where a value that was found may end, likeliest first; other kinds have one reading.
ENDS = {"iban": iban_ends, "card": card_ends}
HAS_DIGIT = re.compile("[0-9]")


def find(text: str, permuter: Permuter) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a text; earlier kinds win overlaps."""
    kinds = []
    if "@" in text:
        kinds.append(("email", EMAIL, email))
    if HAS_DIGIT.search(text):
        kinds += NUMBERS
    found: list = []
    for kind, pattern, change in kinds:
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + 1  # what is no value hides none that starts inside it
            for end in ENDS[kind](m) if kind in ENDS else [m.end()]:
                if any(a < end and m.start() < b for a, b, _, _ in found):
                    continue
                part = m if end == m.end() else pattern.fullmatch(text, m.start(), end)
                if part and (new := change(permuter, part)) is not None:
                    found.append((m.start(), end, kind, new))
                    at = end
                    break
    return sorted(found)


def replace(text: str | None, permuter: Permuter) -> tuple[str | None, list]:
    if not text:
        return text, []
    found, out, at = find(text, permuter), [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    out.append(text[at:])
    return "".join(out), [(kind, start, end) for start, end, kind, _ in found]


def pseudonymise(documents: DataFrame, key: bytes, text_col: str = "text",
                 chars_col: str | None = "n_chars", found_col: str | None = None) -> DataFrame:
    """The documents with their values replaced. ``chars_col`` follows texts that change length.
    ``found_col`` adds an array of (kind, start, end), in characters of the text before."""
    ship(documents.sparkSession)
    kind = "text string, found array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(kind)
    def change(texts: pd.Series) -> pd.DataFrame:
        permuter = Permuter(key)
        done = [replace(t, permuter) for t in texts]
        return pd.DataFrame({
            "text": [t for t, _ in done],
            "found": [[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in done]})

    name = "_pii"
    while name in documents.columns:
        name += "_"
    df = documents.withColumn(name, change(F.col(text_col)))
    new = {text_col: F.col(f"{name}.text")}
    if chars_col in documents.columns:
        same = F.col(f"{name}.text").eqNullSafe(F.col(text_col))
        new[chars_col] = F.when(same, F.col(chars_col)).otherwise(
            F.char_length(f"{name}.text").cast("long"))
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in documents.columns],
                     *([F.col(f"{name}.found").alias(found_col)] if found_col else []))
