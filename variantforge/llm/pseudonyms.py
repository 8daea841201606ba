"""Format-preserving pseudonyms of private numbers, dates, addresses and secrets by a keyed Feistel permutation.

A value is read as a number of its format's domain, permuted there under a key, and written back with the
same separators, so equal values get equal pseudonyms in all documents and none leaves its format.  Values
that fail validation (a card number without its check digit or of no issuer, a date that does not exist, a
phone number of no numbering plan that nothing announces) stay as they are.  What tells a value apart (its
length, its kinds of characters, its prefix, its validity) holds for its pseudonym too, so the same scan undoes it.

In a long run of digit groups every card length is tried at every group, the longest valid one first.  The
run's values are then permuted together until it reads as the same values again, so that it can be undone; a
value that has to be permuted more than once for this has another pseudonym there.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROUNDS = 8
#: Dates from the first to the last of these are permuted among themselves.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def _round(key: bytes, label: str, step: int, half: int, bits: int) -> int:
    raw = hashlib.blake2b(half.to_bytes((bits + 7) // 8, "big"), key=key[:64], person=label.encode()[:16], salt=step.to_bytes(2, "big"), digest_size=(bits + 7) // 8 + 8).digest()
    return int.from_bytes(raw, "big") & ((1 << bits) - 1)


def permute(x: int, size: int, key: bytes, label: str, inverse: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the valid numbers under size: a balanced Feistel network over the next even number of bits, walked until it lands on one. x must be valid."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for step in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                a, b = b ^ _round(key, label, step, a, half), a
            else:
                a, b = b, a ^ _round(key, label, step, b, half)
        x = a << half | b
        if x < size and valid(x):
            return x


def luhn(digits: str) -> int:
    """The check digit that completes digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(text: str, new: str, keep: str) -> str:
    """text with its characters of the set keep replaced in turn by new."""
    it = iter(new)
    return "".join(next(it) if c in keep else c for c in text)


#: Card issuers' ranges of first digits (six of them) with the lengths of their numbers.
ISSUERS = (
    (222100, 272099, (16,)),
    (300000, 305999, (14, 16, 19)),
    (340000, 349999, (15,)),
    (352800, 358999, (16, 17, 18, 19)),
    (360000, 369999, (14, 16, 19)),
    (370000, 379999, (15,)),
    (380000, 399999, (14, 16, 19)),
    (400000, 499999, (13, 16, 19)),
    (500000, 509999, (13, 14, 15, 16, 17, 18, 19)),
    (510000, 559999, (16,)),
    (560000, 699999, (13, 14, 15, 16, 17, 18, 19)),
)


def _issued(digits: str, n: int) -> bool:
    """Whether a card number of n digits begins like one that is given out."""
    first = int(digits[:6])
    return any(low <= first <= high and n in lengths for low, high, lengths in ISSUERS)


def _card(m: str, key: bytes, inverse: bool) -> str | None:
    d = re.sub(r"\D", "", m)
    if luhn(d[:-1]) != int(d[-1]) or not _issued(d, len(d)):
        return None
    n = len(d) - 1
    valid = lambda x: _issued(f"{x:0{n}d}", n + 1)
    new = f"{permute(int(d[:-1]), 10**n, key, f'card{n}', inverse, valid):0{n}d}"
    return _refill(m, new + str(luhn(new)), string.digits)


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(m: str, key: bytes, inverse: bool) -> str | None:
    x = int(re.sub(r"\D", "", m))
    return _refill(m, f"{permute(x, 10**9, key, 'ssn', inverse, _ssn_ok):09d}", string.digits) if _ssn_ok(x) else None


def _iban_ok(country: str, check: str, rest: str) -> bool:
    return int("".join(str(int(c, 36)) for c in rest + country + check)) % 97 == 1


def _iban(m: str, key: bytes, inverse: bool) -> str | None:
    flat = m.replace(" ", "")
    country, check, rest = flat[:2], flat[2:4], flat[4:]
    if not _iban_ok(country, check, rest):
        return None
    new = _runs(rest, key, "iban", inverse)
    made = f"{98 - int(''.join(str(int(c, 36)) for c in new + country + '00')) % 97:02d}"
    return _refill(m, country + made + new, string.ascii_uppercase + string.digits)


def _address(m: str, key: bytes, inverse: bool) -> str | None:
    parts = [int(x) for x in m.split(".")]
    if max(parts) > 255:
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 2**32, key, "ipv4", inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _planned(x: int) -> bool:
    """Whether ten digits fit the North American plan: area and exchange begin with 2 to 9, neither is a service code."""
    area, exchange = x // 10**7, x // 10**4 % 1000
    return area >= 200 and exchange >= 200 and area % 100 != 11 and exchange % 100 != 11


def _phone(m: str, key: bytes, inverse: bool, told: bool = False) -> str | None:
    """The last ten digits are permuted, or all seven of a local number; a country code stays.

    Numbers without a country code must fit the plan, local ones cannot; others count only if a word before announces them (told).
    """
    d = re.sub(r"\D", "", m)
    n = 10 if len(d) >= 10 else 7
    x, valid = int(d[-n:]), lambda _: True
    if "+" not in m and n == 10:
        fits = _planned(x)
        valid = lambda y: _planned(y) == fits
    if not told and "+" not in m and (n == 7 or not fits):
        return None
    return _refill(m, d[:-n] + f"{permute(x, 10**n, key, f'phone{n}', inverse, valid):0{n}d}", string.digits)


def _day(m: str, key: bytes, inverse: bool) -> str | None:
    a, b, c = re.split(r"[-/.]", m)
    sep = re.search(r"[-/.]", m).group()
    try:
        day = datetime.date(int(a), int(b), int(c)) if len(a) == 4 else datetime.date(int(c), int(b), int(a)) if sep == "." else datetime.date(int(c), int(a), int(b))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    first = FIRST_DAY.toordinal()
    new = datetime.date.fromordinal(first + permute(day.toordinal() - first, LAST_DAY.toordinal() - first + 1, key, "day", inverse))
    if len(a) == 4:
        return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
    return f"{new.day:02d}.{new.month:02d}.{new.year:04d}" if sep == "." else f"{new.month:02d}/{new.day:02d}/{new.year:04d}"


_KINDS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def _runs(text: str, key: bytes, label: str, inverse: bool) -> str:
    """text with its digits and letters permuted together, each character within its kind."""
    at = [(i, k) for i, c in enumerate(text) for k in _KINDS if c in k]
    size, x = 1, 0
    for i, k in at:
        size, x = size * len(k), x * len(k) + k.index(text[i])
    if size == 1:
        return text
    shape = hashlib.blake2b("".join(k[0] for _, k in at).encode(), digest_size=6).hexdigest()
    x = permute(x, size, key, f"{label[:4]}{shape}"[:16], inverse)
    out = list(text)
    for i, k in reversed(at):
        x, r = divmod(x, len(k))
        out[i] = k[r]
    return "".join(out)


def _mail(m: str, key: bytes, inverse: bool) -> str | None:
    """The local part, and the domain but for its last label, each by itself: equal domains stay equal."""
    local, _, domain = m.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_runs(local, key, 'mail', inverse)}@{_runs(host, key, 'host', inverse)}.{top}"


def _secret(m: str, key: bytes, inverse: bool) -> str | None:
    """The value after a name and a sign, or after a known prefix, if it has a digit."""
    found = _SECRET.fullmatch(m)
    at = found.start("quoted") if found["quoted"] else found.start("plain") if found["plain"] else found.start("body")
    end = len(m) - 1 if found["quoted"] else len(m)
    value = m[at:end]
    if not re.search(r"\d", value):
        return None
    return m[:at] + _runs(value, key, "secret", inverse) + m[end:]


_FORMS: tuple[tuple[str, str, Callable[[str, bytes, bool], str | None]], ...] = (
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("day", r"\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}:?\d{2}|(?![\w-]))|(?:\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w-])", _day),
    ("ipv4", r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", _address),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("card", r"\d(?:[ -]?\d){12,}", _card),
    ("phone", r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])|\d{3}-\d{4}(?![\d-])", _phone),
)
#: Words that announce a phone number.
_TOLD = re.compile(r"(?i)(?<!\w)(?:phone|telephone|tel|call|fax|mobile|cell|ph|telefon|fon|handy|tél|téléphone|teléfono|móvil)[.:]{0,2}\s{0,3}\Z")
_NUMBER = re.compile("(?<![\\w.@+-])(?:" + "|".join(f"(?P<{name}>{form})" for name, form, _ in _FORMS) + ")")
_FIRST, _ADDRESS, _LAST = (re.compile("|".join(f"(?P<{name}>{form})" for name, form, _ in _FORMS if name in names)) for names in (("day", "ssn"), ("ipv4",), ("phone",)))
_GROUP = re.compile(r"\d+")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Names of secrets that need no quotes, and prefixes of tokens that need no name.
_SECRET = re.compile(
    r"""\w[\w-]{2,39}\s{0,3}[=:]\s{0,3}(?P<mark>["'])(?P<quoted>[A-Za-z0-9_\-+/]{20,}=*)(?P=mark)"""
    r"""|(?i:(?:[\w-]{0,30}(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth|credential)[\w-]{0,9}))\s{0,3}[=:]\s{0,3}(?P<plain>[A-Za-z0-9_\-+/]{20,}=*)(?![\w"'.+/=-])"""
    r"""|(?<![\w-])(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abeprs]-|[spr]k[-_](?:live[-_]|test[-_])?)(?P<body>[A-Za-z0-9_-]{16,})(?![\w-])"""
)
_HINT = re.compile(r"""[=:]\s{0,3}["']?[A-Za-z0-9_\-+/]{20}""")
_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk-", "sk_", "pk-", "pk_", "rk-", "rk_")
_BY_NAME = {name: form for name, _, form in _FORMS}
_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=50_000)
def _one(name: str, found: str, key: bytes, inverse: bool, told: bool = False) -> str | None:
    if name == "phone":
        return _phone(found, key, inverse, told)
    form = {"mail": _mail, "secret": _secret}.get(name) or _BY_NAME[name]
    return form(found, key, inverse)


def _told(name: str, text: str, start: int) -> bool:
    return name == "phone" and _TOLD.search(text, max(0, start - 24), start) is not None


def _in_run(text: str, start: int, stop: int, key: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the values that begin in a run of digit groups; all but cards begin it or follow a space."""
    groups = [m.span() for m in _GROUP.finditer(text, start, stop)]
    out, at = [], start
    for g, (a, _) in enumerate(groups):
        if a < at:
            continue
        ends, n = [], 0
        for b, c in groups[g : g + 19]:
            n += c - b
            if n > 19:
                break
            if n >= 13:
                ends.insert(0, c)
        tries = [("card", c) for c in ends]
        if a == start or text[a - 1] == " ":
            tries = [(m.lastgroup, m.end()) for m in [_FIRST.match(text, a)] if m] + tries + [(m.lastgroup, m.end()) for m in [_LAST.match(text, a)] if m]
        for kind, end in tries:
            if _one(kind, text[a:end], key, False, _told(kind, text, a)) is not None:
                out.append((kind, a, end))
                at = end
                break
    return out


def _put_run(text: str, start: int, stop: int, key: bytes, inverse: bool) -> tuple[str, int, list[str]]:
    """(what replaces the run from start, its end in text, the kinds)."""
    found = _in_run(text, start, stop, key)
    end = max([stop, *(b for _, _, b in found)])
    if not found:
        return text[start:end], end, []
    low = max(0, start - 24)  # what announces a phone number stays before the run
    size, new = end - low, text[low:end]
    same, rest = [(kind, a - low, b - low) for kind, a, b in found], text[end : end + 40]
    while True:
        for kind, a, b in same:
            new = new[:a] + _one(kind, new[a:b], key, inverse, _told(kind, new, a)) + new[b:]
        if len(new) == size and _in_run(new + rest, start - low, stop - low, key) == same:
            return new[start - low :], end, [kind for kind, _, _ in found]


def pseudonymise(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[str]]:
    """(text with its private values replaced, their kinds in order of scanning). inverse undoes it under the same key.

    Secrets are found first and cut the text; what lies between them is scanned by itself for addresses and numbers.
    """
    if not _HINT.search(text) and not any(head in text for head in _HEADS):
        return _between(text, key, inverse)
    kinds: list[str] = []
    parts, at = [], 0
    for m in _SECRET.finditer(text):
        new = _one("secret", m.group(), key, inverse)
        if new is not None:
            before, more = _between(text[at : m.start()], key, inverse)
            parts += [before, new]
            kinds += [*more, "secret"]
            at = m.end()
    rest, more = _between(text[at:], key, inverse)
    return "".join([*parts, rest]), kinds + more


def _between(text: str, key: bytes, inverse: bool) -> tuple[str, list[str]]:
    kinds: list[str] = []
    if "@" in text:
        parts, at = [], 0
        while (i := text.find("@", at)) >= 0:  # only the surroundings of an @ are searched
            start = i
            while start > at and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            m = _MAIL.match(text, start)
            new = _one("mail", m.group(), key, inverse) if m else None
            stop = m.end() if m else i + 1
            if new is not None:
                kinds.append("mail")
            parts += [text[at:start], text[start:stop] if new is None else new]
            at = stop
        text = "".join([*parts, text[at:]])
    if not _DIGIT.search(text):
        return text, kinds
    parts, at = [], 0
    while m := _NUMBER.search(text, at):
        parts.append(text[at : m.start()])
        if m.lastgroup == "card":
            stop, last = m.end(), text.rfind(" ", m.start(), m.end())
            if last > 0 and _ADDRESS.match(text, last + 1):  # changes its length, so it is no part of the run
                stop = last
            new, at, more = _put_run(text, m.start(), stop, key, inverse)
            kinds += more
        else:
            new, at = _one(m.lastgroup, m.group(), key, inverse, _told(m.lastgroup, text, m.start())), m.end()
            if new is None:
                new = m.group()
            else:
                kinds.append(m.lastgroup)
        parts.append(new)
    return "".join([*parts, text[at:]]), kinds


def private(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, text with pseudonyms, n_private and kinds (sorted, one entry a value).

    Mail addresses, secrets (quoted, named or of a known prefix), IBANs, dates, IPv4 addresses, social security, card and
    phone numbers are replaced.  A null text stays null with n_private 0; a text without such values stays
    as it is.  Rows repeated give rows repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for t in batch.column(1):
                new, k = (None, []) if not t.is_valid else pseudonymise(t.as_py(), key, inverse)
                texts.append(new)
                kinds.append(sorted(k))
            counts = pa.array([len(k) for k in kinds], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), counts, pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_private", "kinds"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, text string, n_private bigint, kinds array<string>")
