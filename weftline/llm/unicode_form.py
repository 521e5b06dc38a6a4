"""Visually identical text brought to one consistent form.

The consistent form has composed letters, one script within a word, plain ASCII spaces, digits,
hyphens and quotes, and nothing invisible.  A table from grapheme clusters to their consistent form is
computed once from the Unicode character database (plus a table of look-alike letters), checked for
conflicts, and compiled into a longest-match transducer that rewrites a text in one pass.  Because a
look-alike letter means different things in Greek and in Latin words, there is one table per script of
a word; the script of a word is that of its letters that have no double in another script.

A class of code points, compiled to a bitmap, lets values that are certainly consistent pass by in one
scan; only the rest goes through the transducer.

Defined results
---------------
* null stays null, the empty text stays empty; a text of invisible characters only becomes empty;
* case, missing accents and misspellings are left alone; line ends and tabs are kept;
* a word made only of Cyrillic letters with doubles takes the script that leads in the rest of the text; one made only of
  Greek or only of Latin letters is of one script already and stays;
* the result is a fixed point: applying the operator twice changes nothing more;
* texts of any length are handled whole; repeated rows and extra columns have no influence.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GREEK, LATIN, CYRILLIC = "greek", "latin", "cyrillic"

# Letters that look alike, in the order latin, greek, cyrillic; '.' where a script has no such letter.
LOOKALIKES = """
A|A|Α|А
B|B|Β|В
C|C|Ϲ|С
E|E|Ε|Е
H|H|Η|Н
I|I|Ι|І
J|J|.|Ј
K|K|Κ|К
M|M|Μ|М
N|N|Ν|.
O|O|Ο|О
P|P|Ρ|Р
S|S|.|Ѕ
T|T|Τ|Т
X|X|Χ|Х
Y|Y|Υ|У
Z|Z|Ζ|.
a|a|α|а
c|c|ϲ|с
e|e|ε|е
i|i|ι|і
j|j|.|ј
k|k|κ|к
o|o|ο|о
p|p|ρ|р
s|s|.|ѕ
t|t|τ|т
u|u|υ|.
v|v|ν|ѵ
w|w|ω|ѡ
x|x|χ|х
y|y|γ|у
G|.|Γ|Г
L|.|Λ|Л
D|.|Δ|Д
F|.|Φ|Ф
Pi|.|Π|П
pi|.|π|п
"""

_HYPHENS = {0x2212: "-", 0x2043: "-", 0xFE63: "-"}
_QUOTES = {"'": "‘’‚‛′ʼʹ＇`´ʻ՚", '"': "“”„‟″«»＂〝〞"}
_KEEP = {"\n", "\r", "\t"}


def _script(c: str) -> str | None:
    """The script of a letter, None for anything else."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return LATIN if c.isalpha() and o != 0xB5 and o not in (0xAA, 0xBA) else None
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return GREEK if c.isalpha() else None
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0xA640 <= o < 0xA6A0:
        return CYRILLIC if c.isalpha() else None
    return None


def _invisible(c: str) -> bool:
    o = ord(c)
    cat = ud.category(c)
    return (
        (cat in ("Cf", "Cc", "Co", "Cs") and c not in _KEEP) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF
        or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D, 0x180F)
    )


@lru_cache(maxsize=None)
def _plain(c: str) -> str:
    """The consistent form of one code point by itself, before any look-alike is considered."""
    o = ord(c)
    if o < 0x7F and (o >= 0x20 or c in _KEEP):
        return c
    if _invisible(c):
        return ""
    cat = ud.category(c)
    if cat == "Zs":
        return " "
    if cat in ("Zl", "Zp"):
        return "\n"
    if cat == "Nd":
        return str(ud.digit(c))
    if cat == "Pd" or o in _HYPHENS:
        return "-"
    for q, all_ in _QUOTES.items():
        if c in all_:
            return q
    if o == 0x2026:
        return "..."
    if c in "ϲϹ":
        return {"ϲ": "σ", "Ϲ": "Σ"}[c]
    folded = ud.normalize("NFC", c)
    if 0xFF00 <= o <= 0xFFEF or o == 0xB5 or 0xFB00 <= o <= 0xFB06 or 0x3D0 <= o <= 0x3F9 or 0x1D400 <= o <= 0x1D7FF or 0x2100 <= o <= 0x214F:
        wide = ud.normalize("NFKC", c)
        if wide != c and all(ud.category(x)[0] in "LNPS" for x in wide):
            folded = "".join(_plain(x) if x != c else x for x in wide)
    return folded


def _doubles() -> dict[str, dict[str, str]]:
    """Target script -> {foreign letter: letter of the target}.  Raises if the look-alike table contradicts itself."""
    out: dict[str, dict[str, str]] = {GREEK: {}, LATIN: {}, CYRILLIC: {}}
    for line in LOOKALIKES.strip().splitlines():
        cells = line.split("|")[1:]
        trio = dict(zip((LATIN, GREEK, CYRILLIC), cells))
        for target, to in trio.items():
            if to == ".":
                continue
            for other, frm in trio.items():
                if other != target and frm != ".":
                    to_ = _plain(to)
                    if out[target].get(frm, to_) != to_:
                        raise ValueError(f"conflict: {frm!r} stands for {out[target][frm]!r} and {to_!r} in {target}")
                    out[target][frm] = to_
    return out


class Transducer:
    """Longest-match rewriting over grapheme clusters; one instance is compiled per Python process."""

    def __init__(self) -> None:
        self.doubles = _doubles()
        self.changing = {chr(o) for o in range(0x80, 0x30000) if _plain(chr(o)) != chr(o)}
        self.changing |= {chr(o) for o in [*range(0x20), 0x7F] if _plain(chr(o)) != chr(o)}
        self.ambiguous = {c for m in self.doubles.values() for c in m}
        self.tables = {s: self._table(s) for s in (None, GREEK, LATIN, CYRILLIC)}
        marks = r"\p{M}\p{Cf}"
        # a cluster is worth a look-up if it changes by itself, carries marks or invisibles, or may be a look-alike
        self.cluster = regex.compile(rf"[\p{{L}}\p{{N}}][{marks}]+|[{marks}]+|[^\n\r\t\x20-\x7E]|[A-Za-z]")
        self.cluster_in_word = self.cluster
        self.word = regex.compile(r"(?:[\p{L}\p{M}\p{Cf}\p{Co}\p{Cs}]|[^\P{Cc}\n\r\t])+")

    def _table(self, script: str | None) -> dict[str, str]:
        """Single code points and every canonical (base, marks) sequence whose consistent form differs from it."""
        table: dict[str, str] = {}
        singles = set(self.changing) | (set(self.doubles[script]) if script else set())
        for c in singles:
            table[c] = self._form(c, script)
        for o in range(0xC0, 0x2000):
            seq = ud.normalize("NFD", chr(o))
            if len(seq) > 1:
                self._put(table, seq, self._form(seq, script))
        for c, to in list(table.items()):  # fixed point: what comes out must stay as it is
            again = "".join(table.get(x, x) for x in to)
            if ud.normalize("NFC", again) != to:
                raise ValueError(f"{c!r} becomes {to!r}, which would become {again!r}")
        return table

    @staticmethod
    def _put(table: dict[str, str], key: str, to: str) -> None:
        if table.setdefault(key, to) != to:
            raise ValueError(f"conflict: {key!r} has two forms {table[key]!r} and {to!r}")

    def _form(self, cluster: str, script: str | None) -> str:
        """The consistent form of a cluster, derived from the rules; results are memoised in the tables."""
        out = "".join(_plain(x) for x in ud.normalize("NFD", cluster))
        if script:
            m = self.doubles[script]
            out = "".join(m.get(x, x) for x in ud.normalize("NFD", out))
        return ud.normalize("NFC", out)

    def _rewrite(self, text: str, script: str | None) -> str:
        table = self.tables[script]

        def one(m) -> str:
            c = m.group()
            got = table.get(c)
            if got is None:
                got = self._form(c, script)
                if len(table) < 200_000:
                    table[c] = got
            return got

        return self.cluster.sub(one, text)

    def _votes(self, word: str) -> Counter:
        n: Counter = Counter()
        for c in ud.normalize("NFD", word):
            s = _script(_plain(c)[:1] or c) if c in self.changing else _script(c)
            if s:
                n[s] += 1
                base = _plain(c)[:1] if c in self.changing else c
                if base not in self.ambiguous:
                    n[s, 1] += 1
        return n

    def consistent(self, text: str) -> str:
        """The consistent form of a text; equal texts in, equal texts out, and a fixed point.

        One pass does for all but odd cases, such as a width form whose letters join the words around it.
        """
        seen = set()
        while not (text.isascii() and text.isprintable()):
            done = self._pass(text)
            if done == text:
                break
            if hash(done) in seen:
                raise RuntimeError(f"no fixed point for {text[:80]!r}")
            seen.add(hash(done))
            text = done
        return text

    def _pass(self, text: str) -> str:
        lead: str | None = None
        out: list[str] = []
        at = 0
        votes = [(m.start(), m.end(), self._votes(m.group())) for m in self.word.finditer(text)]
        total: Counter = Counter()
        for _, _, v in votes:
            total.update({s: v[s, 1] for s in (GREEK, LATIN, CYRILLIC) if v[s, 1]})
        if total:
            lead = max((GREEK, LATIN, CYRILLIC), key=lambda s: (total[s], s != CYRILLIC, s == GREEK))
        for a, b, v in votes:
            here = [s for s in (GREEK, LATIN, CYRILLIC) if v[s]]
            script: str | None = None
            if len(here) > 1:
                script = max(here, key=lambda s: (v[s, 1], v[s], s != CYRILLIC, s == GREEK))
            elif here == [CYRILLIC] and not v[CYRILLIC, 1] and lead != CYRILLIC:
                script = lead if lead else LATIN
            out.append(self._rewrite(text[at:a], None))
            out.append(self._rewrite(text[a:b], script))
            at = b
        out.append(self._rewrite(text[at:], None))
        done = ud.normalize("NFC", "".join(out))
        return done


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def consistent_text(text: str | None) -> str | None:
    """Plain-Python form of the operator."""
    return text if text is None or not suspect(text) else transducer().consistent(text)


@lru_cache(maxsize=1)
def _bare_letters() -> dict[int, str]:
    """Code point -> lower-case letter without accents, for str.translate."""
    out = {}
    for o in [*range(0x41, 0x5B), *range(0xC0, 0x2000)]:
        c = "".join(x for x in ud.normalize("NFD", chr(o).lower()) if not ud.combining(x)).replace("ς", "σ")
        if c != chr(o):
            out[o] = c
    return out


def bare(text: str | None) -> str:
    """Consistent, lower-case, without accents, one form of sigma: the form in which names are compared."""
    return (consistent_text(text) or "").translate(_bare_letters())


@lru_cache(maxsize=1)
def _suspects() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Character classes for a quick check: code points that are never calm, Latin letters, and Latin beside Greek."""
    calm = [
        o for o in range(0x20, 0x2FFFF)
        if _plain(chr(o)) == chr(o) and ud.category(chr(o))[0] != "M" and _script(chr(o)) != CYRILLIC and ud.category(chr(o)) != "Cn"
    ]
    spans: list[list[int]] = [[9, 10], [13, 13]]
    for o in calm:
        if spans[-1][1] == o - 1:
            spans[-1][1] = o
        else:
            spans.append([o, o])
    cls = "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in spans)
    latin, greek = r"A-Za-z\u00C0-\u024F\u1E00-\u1EFF", r"\u0370-\u03FF\u1F00-\u1FFF"
    return re.compile(f"[^{cls}]"), re.compile(f"[{latin}]"), re.compile(f"[{latin}][{greek}]|[{greek}][{latin}]")


def suspect(text: str) -> bool:
    """False only for texts that are certainly consistent.  One pass over a code-point bitmap for most texts."""
    if text.isascii() and text.isprintable():
        return False
    odd, latin, beside = _suspects()
    return bool(odd.search(text)) or (bool(latin.search(text)) and bool(beside.search(text)))


def consistent(col: Column | str) -> Column:
    """The consistent form of a text column."""
    c = F.col(col) if isinstance(col, str) else col

    @F.pandas_udf(T.StringType())
    def rewrite(s: pd.Series) -> pd.Series:
        t = transducer()
        return s.map(lambda x: t.consistent(x) if x is not None and suspect(x) else x)

    return rewrite(c)


def inconsistent_rows(df: DataFrame, value: str, *, form: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``value`` is not in the consistent form (with ``form``: and ``consistent_form``;
    a column of that name in the input becomes ``consistent_form_in``)."""
    if form and "consistent_form" in df.columns:
        df = df.withColumnRenamed("consistent_form", "consistent_form_in")
    schema = T.StructType([*df.schema.fields, *([T.StructField("consistent_form", T.StringType())] if form else [])])
    pos = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for b in batches:
            keep, forms = [], []
            for i, x in enumerate(b.column(pos).to_pylist()):
                if x is not None and suspect(x):
                    y = t.consistent(x)
                    if x != y:
                        keep.append(i)
                        forms.append(y)
            if keep:
                out = b.take(pa.array(keep))
                if form:
                    out = out.append_column("consistent_form", pa.array(forms, pa.string()))
                yield out

    return df.mapInArrow(run, schema)


if sys.maxunicode < 0x10FFFF:  # pragma: no cover
    raise RuntimeError("a wide Unicode build is needed")
