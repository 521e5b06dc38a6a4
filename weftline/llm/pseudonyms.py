"""Format-preserving pseudonyms: keyed Feistel permutations of validated numbers and dates within their own format.

A number goes to another number of its format and kind: what was valid (a check letter, a country's plan, a calendar date)
stays valid, what was not stays so by the same error.  A phone number is permuted by its national digits, so it keeps one
stand-in however it is dialled.  With the key every permutation can be undone (``back``); without it none can.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
from functools import lru_cache

from weftline.llm import pii_forms as P


def feistel_digits(digits: str, key: bytes, rounds: int = 10, back: bool = False) -> str:
    """A keyed permutation of the digit strings of one length (``back`` undoes it): an alternating Feistel network."""
    n = len(digits)
    if n < 2:
        shift = int.from_bytes(hmac.new(key, b"one", hashlib.sha256).digest()[:4], "big") % 10
        return "".join(str((int(c) + (-shift if back else shift)) % 10) for c in digits)
    u = n // 2
    a, b = digits[:u], digits[u:]

    def f(i: int, half: str, width: int) -> int:
        d = hmac.new(key, f"{n}:{i}:{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(d[:16], "big") % 10**width

    for i in range(rounds) if not back else reversed(range(rounds)):
        if i % 2 == 0:
            s = f(i, b, len(a))
            a = str((int(a) + (-s if back else s)) % 10 ** len(a)).zfill(len(a))
        else:
            s = f(i, a, len(b))
            b = str((int(b) + (-s if back else s)) % 10 ** len(b)).zfill(len(b))
    return a + b


def permute_within(value: int, size: int, key: bytes, back: bool = False, keep=None) -> int:
    """A keyed permutation of 0..size-1 by cycle walking; with ``keep`` it stays among the values of which that is as true as of ``value``."""
    width = max(2, len(str(size - 1)))
    kind = keep(value) if keep else None
    x = value
    while True:
        x = int(feistel_digits(str(x).zfill(width), key, back=back))
        if x < size and (keep is None or keep(x) == kind):
            return x


def _refill(value: str, at: list[int], digits: str) -> str:
    out = list(value)
    for i, c in zip(at, digits):
        out[i] = c
    return "".join(out)


def phone_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Country, first digit and format stay; numbers of the North American plan stay numbers of it, others stay outside it."""
    nsn, at = P.national_number(value)
    if len(nsn) < 2:
        return value
    first, n = nsn[0], len(nsn) - 1

    def american(x: int) -> bool:
        d = first + str(x).zfill(n)
        return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789" and d[1:3] != "11" and d[4:6] != "11"

    new = permute_within(int(nsn[1:]), 10**n, key + first.encode(), back, american)
    return _refill(value, at, first + str(new).zfill(n))


@lru_cache(maxsize=256)
def _alphabet(c: str) -> str:
    return "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else ""


def mixed_pseudonym(value: str, key: bytes, back: bool = False, keep=None) -> str:
    """Digits go to digits, capitals to capitals, all as one number of mixed radix; everything else stays in place."""
    at = [i for i, c in enumerate(value) if _alphabet(c)]
    x, size = 0, 1
    for i in at:
        base = _alphabet(value[i])
        x, size = x * len(base) + base.index(value[i]), size * len(base)

    def spell(n: int) -> str:
        out = []
        for i in reversed(at):
            base = _alphabet(value[i])
            out.append(base[n % len(base)])
            n //= len(base)
        return _refill(value, at, "".join(reversed(out)))

    if size < 2:
        return value
    test = (lambda n: keep(spell(n))) if keep else None
    return spell(permute_within(x, size, key + _shape(value), back, test))


def _shape(value: str) -> bytes:
    return "".join("9" if c.isdigit() else "A" for c in value if _alphabet(c)).encode()


def _checked(value: str, key: bytes, back: bool, body: int, check) -> str:
    """Permute the first ``body`` digits and move the check along: a right one stays right, a wrong one wrong by as much.

    ``check(digits) -> (expected, got, write)`` in the numbers of the scheme."""
    at = [i for i, c in enumerate(value) if c.isdigit()][:body]
    old = "".join(value[i] for i in at)
    new = feistel_digits(old, key + str(body).encode(), back=back)
    return check(_refill(value, at, new), old, new)


def id_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """By the scheme of the number: the check letter or digits of its kind, else digits and letters within their classes."""
    digits = "".join(c for c in value if c.isdigit())
    if P.re.fullmatch(r"(?:\d\d\.\d{3}\.\d{3}|\d{8})-?[A-Z]", value) and value[-1] in P.DNI_LETTERS:
        return _checked(value, key, back, 8, lambda v, o, n: v[:-1] + P.DNI_LETTERS[(P.DNI_LETTERS.index(value[-1]) - int(o) + int(n)) % 23])
    if P.re.fullmatch(r"[XYZ]-?\d{7}-?[A-Z]", value) and value[-1] in P.DNI_LETTERS:
        lead = P.nie_digits(value[0])
        return _checked(value, key + value[0].encode(), back, 7, lambda v, o, n: v[:-1] + P.DNI_LETTERS[(P.DNI_LETTERS.index(value[-1]) - int(lead + o) + int(lead + n)) % 23])
    if len(digits) == 15 and digits[0] in "12" and 1 <= int(digits[13:]) <= 97:
        at = [i for i, c in enumerate(value) if c.isdigit()]
        wrong = (int(digits[13:]) - P.nir_key(digits[:13])) % 97
        body = digits[0] + feistel_digits(digits[1:13], key + b"nir", back=back)
        return _refill(value, at, body + str((P.nir_key(body) + wrong - 1) % 97 + 1).zfill(2))
    if len(digits) == 9 and P.re.fullmatch(r"\d{3}([- ])\d\d\1\d{4}", value):
        return mixed_pseudonym(value, key, back, lambda v: P.valid_ssn("".join(c for c in v if c.isdigit())))
    m = P.re.fullmatch(r"([A-Z]{2})( ?\d\d ?\d\d ?\d\d ?)([A-D])", value)
    if m:
        return m[1] + mixed_pseudonym(m[2], key + m[1].encode(), back) + m[3]
    return mixed_pseudonym(value, key, back)


#: days that dates of birth are permuted among: from 1900 to 2099
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def date_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Another day between 1900 and 2099, in the same format; the same day in another format has the same stand-in."""
    iso = "-" in value
    parts = [int(x) for x in P.re.split(r"[-./]", value)]
    y, m, d = parts if iso else parts[::-1]
    day = datetime.date(y, m, d).toordinal() - _DAY0
    if not 0 <= day < _DAYS:
        return value
    new = datetime.date.fromordinal(_DAY0 + permute_within(day, _DAYS, key, back))
    if iso:
        return new.isoformat()
    sep = "." if "." in value else "/"
    return f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"


@lru_cache(maxsize=50_000)
def stand_in(kind: str, value: str, key: bytes, back: bool = False) -> str:
    """The stand-in of a detail, without its brackets.  Mail and street addresses and names have a keyed digest."""
    own = hmac.new(key, kind.encode(), hashlib.sha256).digest()
    if kind == "phone":
        return phone_pseudonym(value, own, back)
    if kind == "id_number":
        return id_pseudonym(value, own, back)
    if kind == "date":
        return date_pseudonym(value, own, back)
    norm = " ".join(sorted(value.lower().replace(",", " ").split())) if kind == "name" else P.plain_email(value) if kind == "email" else value.lower()
    return hmac.new(own, norm.encode(), hashlib.sha256).hexdigest()[:8]
