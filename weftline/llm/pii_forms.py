"""Private details that show by their form: mail addresses, phone numbers, numbers of persons, street addresses, dates of birth.

Numbers are found first and judged afterwards: by the plan of their country (lengths, first digits), by their check
digit or letter where the scheme has one, and by a label in the words before them.  A number without a label counts only
if its plan or check says so; a labelled one counts in any grouping.
"""

from __future__ import annotations

import re as sre
from collections.abc import Iterator

import regex as re

# -- mail ----------------------------------------------------------------------------------------------------------------------

_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_AT_SIGN = r"\s?[\[({<]\s?(?:at|ät|arobase|arroba|chez|@)\s?[\])}>]\s?"
_AT_WORD = r"\s(?:at|AT|arobase|arroba)\s"
_DOT_SIGN = r"\s?[\[({<]\s?(?:dot|point|punto|punkt|\.)\s?[\])}>]\s?"
_DOT_WORD = r"\s(?:dot|DOT|punto|punkt)\s"
# Generic top domains, for the one form that plain prose could imitate ("x at y.z").
_TOP = r"(?:org|net|com|edu|gov|int|info|biz|app|dev|io|shop|store|online|site|test|example|invalid|localhost|\p{Ll}{2})"
EMAIL_TAIL = re.compile(
    rf"(?<=[\p{{L}}\p{{N}}])(?:@{_LABEL}(?:\.{_LABEL})+(?![\p{{L}}\p{{N}}])"
    rf"|(?:{_AT_SIGN}|{_AT_WORD}){_LABEL}(?:(?:{_DOT_SIGN}|{_DOT_WORD}|\.){_LABEL})*(?:{_DOT_SIGN}|{_DOT_WORD})\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}-])"
    rf"|{_AT_SIGN}{_LABEL}(?:\.{_LABEL})+(?![\p{{L}}\p{{N}}])"
    rf"|{_AT_WORD}{_LABEL}(?:\.{_LABEL})*\.{_TOP}(?![\p{{L}}\p{{N}}-]))",
    re.I,
)
#: what an address's sign can look like from its first letter on (white space of any kind counts as a blank)
_SIGNS = ("@", " at ", " arobase ", " arroba ")
_BRACKETED = sre.compile(r"(?<=[\[({<]) ?(?:at|ät|arobase|arroba|chez|@)")
_BLANKS = sre.compile(r"[^\S ]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses are found by their sign and what follows; the part before it is read backwards from there."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # letters that grow must not move the others
    low = _BLANKS.sub(" ", low)
    at = set()
    for sign in _SIGNS:
        k = low.find(sign)
        while k >= 0:
            at.add(k)
            k = low.find(sign, k + 1)
    if "[" in low or "(" in low or "<" in low or "{" in low:
        for m in _BRACKETED.finditer(low):
            at.add(m.start() - 1 - (low[m.start() - 2 : m.start() - 1] == " "))
    last = 0
    for k in sorted(at):
        if k < last:
            continue
        m = EMAIL_TAIL.match(text, k)
        if not m:
            continue
        a = k
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        while not text[a].isalnum():
            a += 1
        if last <= a < k:
            last = m.end()
            yield a, last


def plain_email(value: str) -> str:
    """A disguised address written plainly, in lower case."""
    s = re.sub(rf"{_AT_SIGN}|{_AT_WORD}", "@", value, count=1, flags=re.I)
    return re.sub(rf"{_DOT_SIGN}|{_DOT_WORD}", ".", s, flags=re.I).lower()


# -- labels ----------------------------------------------------------------------------------------------------------------------

#: fixed values: words that announce the number of something that is no person
_THING = sre.compile(r"(?:\b(?:inv|tm|hgv|vol|bd|tome|fig|no|nr|see|game|spiel|partido|match|col|line|page|pp?|ref|item|order|invoice|isbn|issn|doi|cat|lot|sku|s|o)\.?|#)[  ]$", sre.I)
#: fixed values: words that announce a phone number
_PHONE_LABEL = sre.compile(
    r"(?:\b(?:tel|tél|t[ée]l[ée]phone|telefon|tel[ée]fono|phone|fon|cell|cellular|mobile|mobil|m[oó]vil|handy|portable|fax|ring|call|dial|text|sms|whatsapp|appelez|appeler|joindre|llame|llamar|rufen|anrufen|"
    r"number|num[ée]ro|n[uú]mero|nummer)\b(?:[ ]+(?:me|us|him|her|them|number|is|on|at|under|au|le|la|al|a|unter|me on|ist|es|est))*|\breach[ ]\w+[ ](?:on|at))\.?[ ]?:?[  ]?$",
    sre.I,
)
_FILLER = r"(?:[  ]?[:#][  ]?|[  ]+(?:number|numbers|no\.?|nr\.?|n[°º]\.?|num\.?|card|is|was|of|porte|le|la|du|de|d['’]identit[ée]|nationale?|lautet|ist|es|est|n[uú]mero|num[ée]ro|nummer|id))"
#: fixed values: words that announce the number of a person
_ID_LABEL = sre.compile(
    r"(?:\b(?:[Pp]assports?|PASSPORT|[Pp]asseport|[Pp]asaporte|[Rr]eisepass|[Pp]ass-?[Nn](?:ummer|r\.?)|(?:[Pp]ersonal)?[Aa]usweis(?:nummer|-?[Nn]r\.?)?|[Ii]dentity|[Ii]dentit[ée]|[Ii]dentidad|IDs?|DNI|NIE|NIF|"
    r"SSN|NINO|NIR|[Nn]ational [Ii]nsurance|[Ss]ocial [Ss]ecurity|[Ss]écurité sociale|[Ss]eguridad [Ss]ocial|[Ss]ozialversicherungsnummer|[Ss]teuer-?(?:ID|[Nn]ummer|identifikationsnummer)|[Tt]ax(?:payer)? ?(?:ID|id|number)|"
    r"[Cc]arte|[Dd]ossier|[Dd]ocumento|[Dd]river'?s? licen[cs]e|[Ff]ührerschein(?:nummer)?)\b)" + _FILLER + r"*[  ]$"
)

# -- numbers of persons --------------------------------------------------------------------------------------------------------

# The letters that stand for the remainders of Spanish identity numbers.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni_letter(digits: str) -> str:
    return DNI_LETTERS[int(digits) % 23]


def nie_digits(first: str) -> str:
    return "012"["XYZ".index(first)]


def nir_key(digits: str) -> int:
    return 97 - int(digits) % 97


def valid_ssn(digits: str) -> bool:
    """Area, group and serial number that may be issued."""
    return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"


def valid_nino(letters: str) -> bool:
    """Prefixes that may be issued."""
    return letters[0] not in "DFIQUV" and letters[1] not in "DFIOQUV" and letters not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


_ID_CHUNK = sre.compile(r"(?<![^\W_])(?:[A-Z]{1,3} ?)?\d(?:[ .\-]?[\dA-Z]){4,}")
_EDGE = r"(?![\p{L}\p{N}])"
#: forms of the numbers of persons, with the test that a number without a label has to pass (None: it needs a label)
ID_FORMS = (
    ("ssn", re.compile(r"\d{3}([- ])\d\d\1\d{4}" + _EDGE), lambda v: "-" in v and valid_ssn("".join(c for c in v if c.isdigit()))),
    ("nino", re.compile(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]" + _EDGE), lambda v: valid_nino(v[:2])),
    ("dni", re.compile(r"(?:\d\d\.\d{3}\.\d{3}|\d{8})-?[A-Z]" + _EDGE), lambda v: dni_letter("".join(c for c in v if c.isdigit())) == v[-1]),
    ("nie", re.compile(r"[XYZ]-?\d{7}-?[A-Z]" + _EDGE), lambda v: dni_letter(nie_digits(v[0]) + "".join(c for c in v if c.isdigit())) == v[-1]),
    ("nir", re.compile(r"[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d" + _EDGE), lambda v: nir_key(_digits(v)[:13]) == int(_digits(v)[13:])),
    ("tax11", re.compile(r"\d\d ?\d{3} ?\d{3} ?\d{3}" + _EDGE), None),
    ("any", re.compile(r"\p{Lu}{0,3} ?\d(?:[\d\p{Lu}]|[.-](?=[\d\p{Lu}])| (?=\d))*[\p{Lu}\d]" + _EDGE), None),
)


def _digits(v: str) -> str:
    return "".join(c for c in v if c.isdigit())


def id_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of persons: labelled ones in any known form, others by their check."""
    for m in _ID_CHUNK.finditer(text):
        a = m.start()
        if m.group().startswith(("ID ", "DNI ", "NIE ", "NIF ", "SSN ", "NIR ")):
            a += m.group().index(" ") + 1
        if a and (text[a - 1] in ".,/-" and a > 1 and text[a - 2].isdigit()):
            continue
        labelled = bool(_ID_LABEL.search(text, max(0, a - 60), a))
        if not labelled and _THING.search(text, max(0, a - 12), a):
            continue
        for name, form, test in ID_FORMS:
            if not labelled and test is None:
                break
            hit = form.match(text, a)
            if hit and (labelled or test(hit.group())) and not (text[hit.end() : hit.end() + 1] in ("-", "/") and text[hit.end() + 1 : hit.end() + 2].isdigit()):
                if name != "any" or len(_digits(hit.group())) >= 5:
                    yield a, hit.end()
                    break


# -- phone numbers -----------------------------------------------------------------------------------------------------------------

# Country calling codes with the least and most digits of a national number; any other code: 6 to 12.
PLANS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11),
    "40": (9, 9), "41": (9, 9), "43": (5, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 12), "51": (8, 9), "52": (10, 10),
    "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9),
    "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "98": (10, 10), "212": (9, 9), "213": (8, 9),
    "216": (8, 8), "234": (8, 10), "254": (9, 9), "351": (9, 9), "352": (4, 11), "353": (7, 9), "354": (7, 9), "358": (5, 12), "359": (7, 9), "370": (8, 8),
    "371": (8, 8), "372": (7, 8), "380": (9, 9), "381": (8, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "961": (7, 8),
    "962": (8, 9), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}
_ZONES = sre.compile(r"[17]|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_PHONE_CHUNK = sre.compile(r"(?<![^\W_])[+(]{0,2}\d(?:[  ().\-/]{0,3}\d){6,}")
_INTL = sre.compile(r"\(?(?:\+ ?|00 ?)(?=\d)")
_GROUPS = sre.compile(r"\d+")
_NANP = sre.compile(r"(?:(?:\+?1)[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])([2-9]\d\d)[ .-](\d{4})(?!\d)")
_NANP_FLAT = sre.compile(r"1?[2-9]\d\d[2-9]\d{6}(?!\d)")
_TRUNK = sre.compile(r"(?:\(0[1-9]\d{0,4}\)|0[1-9]\d{0,4})(?:[ ./-]{1,2}\d{1,8}|(?<=\))\d{2,8}){1,5}(?!\d)|0[1-9](?:[ .-]?\d\d){4}(?!\d)|0[1-9]\d{8,9}(?!\d)")
_SPAIN = sre.compile(r"[6-9]\d\d(?:([ -])\d{3}\1\d{3}|([ -])\d\d\2\d\d\2\d\d)(?!\d)|[6-9]\d{8}(?!\d)")


def country_of(digits: str) -> tuple[str, int, int]:
    """(code, least, most) of the calling code that ``digits`` begin with."""
    for n in (1, 2, 3):
        if digits[:n] in PLANS:
            return (digits[:n], *PLANS[digits[:n]])
    m = _ZONES.match(digits)
    return (m.group() if m else "", 6, 12)


def _international(text: str, a: int, end: int) -> int | None:
    """Where the international number that begins at ``a`` ends, if its length fits the plan of its country."""
    m = _INTL.match(text, a)
    if not m:
        return None
    got, best = "", None
    for g in _GROUPS.finditer(text, m.end(), end):
        if text[g.start() - 1] == "(" and text[g.end() : g.end() + 1] == ")" and g.group() == "0":
            continue  # the trunk digit that is dialled inside the country only
        got += g.group()
        code, least, most = country_of(got)
        if code and least <= len(got) - len(code) <= most:
            best = g.end()
        if len(got) - len(code) > most:
            break
    return best


def _phone_at(text: str, a: int, end: int) -> tuple[int, bool] | None:
    """(end, whether the form alone shows a phone number) of the number that begins at ``a``."""
    stop = _international(text, a, end)
    if stop:
        return stop, True
    m = _NANP.match(text, a, end)
    if m and m.group(1)[1:] != "11":
        return m.end(), True
    m = _TRUNK.match(text, a, end)
    if m and 9 <= len(_digits(m.group())) <= 12:
        return m.end(), any(not c.isdigit() for c in m.group())
    m = _SPAIN.match(text, a, end)
    if m:
        return m.end(), not m.group().isdigit()
    m = _NANP_FLAT.match(text, a, end)
    return (m.end(), False) if m else None


def phones(text: str) -> Iterator[tuple[int, int]]:
    """Phone numbers by the plan of a country, or labelled with at least seven digits."""
    for m in _PHONE_CHUNK.finditer(text):
        a, end = m.span()
        if end < len(text) and text[end].isalpha() or a > 1 and text[a - 1] in ".,/-" and text[a - 2].isdigit():
            continue
        if text[end : end + 1] in ("-", "/") and text[end + 1 : end + 2].isalnum():
            continue
        labelled = bool(_PHONE_LABEL.search(text, max(0, a - 50), a))
        if not labelled and _THING.search(text, max(0, a - 12), a):
            continue
        hit = _phone_at(text, a, end)
        if hit and (labelled or hit[1]) and (hit[0] == end or text[hit[0]] in "  )"):
            yield a, hit[0]
        elif labelled:
            whole = text[a:end]
            if whole.count("(") > whole.count(")"):
                whole = whole[: whole.rindex("(")].rstrip()
            if 7 <= len(_digits(whole)) <= 15:
                yield a, a + len(whole)


def national_number(value: str) -> tuple[str, list[int]]:
    """The digits of a phone number that stay the same however it is dialled, and their places in ``value``."""
    at = [i for i, c in enumerate(value) if c.isdigit()]
    m = _INTL.match(value)
    digits = "".join(value[i] for i in at)
    if m:
        skip = len(_digits(m.group()))
        skip += len(country_of(digits[skip:])[0])
        hole = value.find("(0)")
        at = [i for k, i in enumerate(at) if k >= skip and not (hole >= 0 and i == hole + 1)]
    elif len(digits) == 11 and digits[0] == "1":
        at = at[1:]
    elif digits[0] == "0":
        at = at[1:]
    return "".join(value[i] for i in at), at


# -- street addresses ------------------------------------------------------------------------------------------------------------

_CAP = r"\p{Lu}[\p{L}'’-]*"
_EN_TYPE = r"(?:Street|Road|Lane|Avenue|Close|Way|Terrace|Drive|Court|Crescent|Place|Square|Hill|Row|Walk|Gardens|Grove|Mews|Parade|Boulevard|(?:St|Rd|Ave|Ln|Dr|Ct|Blvd|Ter)\b(?:\.(?=[.,;:!?)]|\s\p{Ll}))?)"  # a full stop that ends the sentence is none of the address's
_FR_TYPE = r"(?:rue|avenue|av\.|place|pl\.|boulevard|bd\.?|chemin|impasse|quai|allée|cours|passage)"
_ES_TYPE = r"(?:[Cc]alle|C/|Avda\.|Avenida|Av\.|Paseo|Plaza|Pza\.|Camino|Ronda|Travesía)"
#: street addresses: a form, and what has to stand in a text for it: a pattern, or ends and parts of what stands before a number
ADDRESSES = (
    (re.compile(rf"(?<![\p{{L}}\p{{N}}.,/-])\d{{1,4}}[a-z]? (?:{_CAP} ){{1,4}}?{_EN_TYPE}(?!\p{{L}})"), sre.compile(r"\d[a-z]? [A-ZÀ-Þ]")),
    (re.compile(rf"(?<![\p{{L}}\p{{N}}.,/-])\d{{1,4}}(?: (?:bis|ter|quater))?,? {_FR_TYPE} (?:(?:de la|de l['’]|du|des|de|d['’]|le|la|les|aux?) ?)?{_CAP}(?: {_CAP})?(?<!\s(?:Le|La|Les|Il|Une?|Cette|En|Tél|Mme|Merci|Écrivez|Passage))"), sre.compile(r"\d(?: bis| ter| quater)?,? (?:rue|av|pl|b(?:oulevar)?d|chemin|impasse|quai|allée|cours|passage)")),
    (re.compile(rf"(?<![\p{{L}}\p{{N}}])(?:\p{{Lu}}\p{{Ll}}+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|hof)|(?:Am|An der|Auf dem|Unter den) {_CAP}|{_CAP}(?:er)? (?:Straße|Str\.|Weg|Gasse|Platz|Allee)) \d{{1,4}}(?: ?[a-z](?!\p{{L}}))?(?:/\d{{1,3}})?(?![\p{{L}}\p{{N}}])"), (("straße ", "strasse ", "str. ", "Straße ", "Str. ", "weg ", "Weg ", "gasse ", "Gasse ", "latz ", "llee ", "ring ", "ufer ", "damm ", "hof "), ("Am ", "An der ", "Auf dem ", "Unter den "))),
    (re.compile(rf"(?<![\p{{L}}\p{{N}}]){_ES_TYPE} (?:(?:de los|de las|de la|del|de|los|las|la|el) )?{_CAP}(?: {_CAP}){{0,2}},? (?:n[º°.o]\.? ?)?\d{{1,4}}(?: ?[a-z](?!\p{{L}}))?(?![\p{{L}}\p{{N}}])"), ((), ("alle ", "C/ ", "Avda. ", "Avenida ", "Av. ", "Paseo ", "Plaza ", "Pza. ", "Camino ", "Ronda ", "Travesía "))),
)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    near = [text[max(0, m.start() - 160) : m.start() + 1] for m in _NUMBER.finditer(text)]
    for form, hints in ADDRESSES:
        if hints.search(text) if isinstance(hints, sre.Pattern) else any(n.endswith(hints[0]) or any(x in n for x in hints[1]) for n in near):
            for m in form.finditer(text):
                yield m.span()


#: a number in words: what stands before it tells whether a street may end there
_NUMBER = sre.compile(r" (?=\d)")


# -- dates of birth --------------------------------------------------------------------------------------------------------------

_BIRTH = sre.compile(
    r"(?:\bborn(?: on)?|\bdate of birth|\bDOB|\bbirthday(?: is)?|\bnée? le|\bdate de naissance|\bgeboren(?: am)?|\bgeb\.|\bGeburtsdatum|\bnacid[oa](?: el)?|\bfecha de nacimiento)[ :]{1,3}"
    r"(?P<d>(?P<y1>\d{4})-(?P<m1>\d\d)-(?P<d1>\d\d)|(?P<d2>\d{1,2})[./](?P<m2>\d{1,2})[./](?P<y2>\d{4}))(?!\d)",
    sre.I,
)


def birth_dates(text: str) -> Iterator[tuple[int, int]]:
    """Dates of the calendar that a text calls somebody's birth."""
    import datetime

    for m in _BIRTH.finditer(text):
        try:
            datetime.date(int(m["y1"] or m["y2"]), int(m["m1"] or m["m2"]), int(m["d1"] or m["d2"]))
        except ValueError:
            continue
        yield m.span("d")
