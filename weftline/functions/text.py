"""Text expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata as ud

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that plain web text uses, in the order in which they are undone (the ampersand last).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def _fold_pairs() -> tuple[str, str]:
    """Accented letters of the Latin and Greek blocks and the bare letters they fold to."""
    src, dst = [], []
    for o in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        c = chr(o)
        b = "".join(x for x in ud.normalize("NFD", c) if not ud.combining(x))
        if len(b) == 1 and b != c:
            src.append(c)
            dst.append(b)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_pairs()


def squeeze(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_accents(c: Column) -> Column:
    """Letters without accents (precomposed letters of the Latin and Greek blocks, and free combining marks)."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), FOLD_FROM, FOLD_TO)


def undo_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_markup(c: Column) -> Column:
    """Tags go, entities are undone, white space is squeezed; null becomes the empty text."""
    return F.coalesce(squeeze(undo_entities(F.regexp_replace(c, r"<[^>]+>", ""))), F.lit(""))


def trim_chars(c: Column, chars: str = r"\s.,;:!?()\[\]{}\"'") -> Column:
    """Punctuation off both ends."""
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def person_name(c: Column) -> Column:
    return trim_chars(squeeze(undo_entities(c)))


def drop_remark(c: Column) -> Column:
    """A trailing ``(?)`` goes, then any trailing parenthesis; a text that would become empty stays as it is."""
    once = F.trim(F.regexp_replace(c, r"\s*\(\?\)\s*$", ""))
    twice = F.trim(F.regexp_replace(once, r"\s*\([^()]*\)\s*$", ""))
    return F.when(twice == "", c).otherwise(twice)


def old_spelling(c: Column) -> Column:
    """Orthographic folding of old prints: ligatures open, r rotunda, u and v alike, lower case."""
    c = F.lower(F.trim(c))
    for a, b in (("ǣ", "ae"), ("æ", "ae"), ("œ", "oe"), ("ꝛ", "r"), ("ſ", "s"), ("u", "v")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def words(c: Column) -> Column:
    """Lower-case words and sentence marks, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z']+|[.!?])"), F.lit(1))


def letters_words(c: Column) -> Column:
    """Runs of letters of any script, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), F.lit(1))


def capitalised(c: Column, least: int = 3, most_words: int = 3) -> Column:
    """Distinct capitalised phrases of up to ``most_words`` words, in order of appearance."""
    more = r"(?:\s\p{Lu}\p{Ll}+){0," + str(most_words - 1) + "}"
    found = F.regexp_extract_all(c, F.lit(r"(\p{Lu}\p{Ll}+" + more + ")"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= least))


def mentions(c: Column, pattern: str) -> Column:
    """How often a pattern occurs; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def sentence_length(c: Column) -> Column:
    """Mean number of words of the sentences of a text; null without sentences."""
    sentences = F.filter(F.transform(F.split(c, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    total = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(F.split(s, r"\s+")))
    return F.when(F.size(sentences) > 0, total / F.size(sentences))


def rejoin(tokens: Column) -> Column:
    """Tokens to text: marks close up, sentences begin with a capital."""
    def step(acc, t):
        mark = t.isin(".", "!", "?")
        starts = (acc == "") | acc.rlike(r"[.!?]$")
        word = F.when(starts, F.initcap(t)).otherwise(t)
        return F.when(mark, F.concat(acc, t)).when(acc == "", word).otherwise(F.concat(acc, F.lit(" "), word))

    return F.aggregate(tokens, F.lit(""), step)


def decorated_number(c: Column) -> Column:
    """The number in texts such as ``72°F``, ``$1,105.2`` or ``+22.3K YoY``; null where there is none."""
    n = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([-+]?[0-9]*\.?[0-9]+)", 1)
    return F.nullif(n, F.lit("")).try_cast("double")


def page_address(c: Column) -> Column:
    """A page's address without query, fragment and trailing slashes."""
    return F.regexp_replace(F.split_part(F.split_part(c, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), r"/+$", "")


def address_kind(c: Column) -> Column:
    """What an address points at, by its form; the first rule that fits decides."""
    return (
        F.when(c.rlike(r"^https?://(www\.)?(youtube\.com|youtu\.be)/"), "video").when(c.rlike(r"\.(mp3|m4a|wav|ogg)$"), "audio")
        .when(c.rlike(r"(/feed|\.rss|\.xml)$"), "feed").when(c.rlike(r"^https?://"), "page").otherwise("file")
    )


def beside(path: Column, suffix: str) -> Column:
    """A file's name with ``suffix`` before its extension: ``a/b.csv`` -> ``a/b_x.csv``."""
    stem, ext = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.concat(stem, F.lit(suffix), ext)


def piped(c: Column, names: tuple[str, ...] = ("url", "title", "description", "folder")) -> Column:
    """A record of fields split by ``|``; blank and absent fields are null."""
    parts = F.split(c, r"\|")
    return F.struct(*[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])


def signs(c: Column) -> Column:
    """Syllables of a transliterated word: subscripts off, ``*nnn`` unknown, split at hyphens, numbers and blanks out."""
    bare = F.regexp_replace(c, "[₀₁₂₃₄₅₆₇₈₉]", "")
    parts = F.transform(F.split(bare, "-"), lambda s: F.regexp_replace(F.trim(s), r"^\*[0-9]+$", "UNK"))
    return F.filter(parts, lambda s: (s != "") & ~s.rlike(r"^[0-9]+$"))


def name_key(c: Column) -> Column:
    """First word, lower case, without full stops."""
    return F.replace(F.lower(F.split_part(F.trim(c), F.lit(" "), F.lit(1))), F.lit("."), F.lit(""))


# The nominatives of Greek declensions (accents folded, lower case) and the endings of their other cases, the
# longer ones first.
DECLENSIONS = {
    "ων": ("ωνος", "ωνι", "ωνα"),
    "αιος": ("αιου", "αιωι", "αιον"),
    "ιος": ("ιου", "ιωι"),
    "ευς": ("εως",),
    "ος": ("ου",),
}


def nominative(c: Column, least: int = 4) -> Column:
    """A folded Greek name in the nominative: the first ending that fits and leaves ``least`` letters decides."""
    out = c
    for new, old in reversed([(n, o) for n, olds in DECLENSIONS.items() for o in olds]):
        changed = F.concat(F.substring(c, F.lit(1), F.length(c) - F.lit(len(old))), F.lit(new))
        out = F.when(c.endswith(old) & (F.length(changed) >= least), changed).otherwise(out)
    return out


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for texts without anything in common."""
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
