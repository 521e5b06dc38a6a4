"""A tagger for names of modern persons, trained on weak labels in all texts.

A candidate is a run of capitalised words and initials (or of words in small letters that the language doesn't use).  Its
weak label is whether a list of forenames knows one of its words; the classifier never sees that word itself, only what
a reader would go by: the words around it, classes of such words, shape, ending and surname.  Because the list is
incomplete, unlabelled candidates are not all negative; the score is therefore divided by the mean score of the labelled
ones (the correction for positive and unlabelled data), and a known forename adds its own evidence afterwards.

General knowledge (titles, verbs that take persons, signatures, words of places and teams) enters as the prior mean of the
weights of class features.  Data move the weights from there; without any labels the prior alone decides.
"""

from __future__ import annotations

import re as sre
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.pii_forms import emails
from weftline.session import cut_lineage

_W = r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*"
_CAP = r"\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*"
_INI = r"\p{Lu}\."
_PART = r"(?:van der|van den|van|von der|von und zu|von|zu|de la|de los|de las|de|del|della|di|da|du|des|le|la|ter|ten)"
_LEAD = re.compile(r"(?<!\p{L})(?:van der|van den|van|von der|von und zu|von|della|di|da|ter|ten|de la|de los|de las|del|du|VAN|VON|DE LA|DEL|DU) $")
# possessive: a run is taken as it stands or not at all
RUN = re.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}'’_@/.&-])(?:{_INI}|{_CAP})(?:(?:,? |(?<=\.))(?:{_PART} |[dD]['’])?(?:{_INI}|{_CAP}))+")
_TOKEN = re.compile(rf"(?P<i>{_INI})|(?P<w>{_W})")
_LOW = re.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}'’_@/.-])(?=\p{{Ll}})(?:(?:{_W}|\p{{L}}\.) (?:\p{{L}}\. )*(?:{_PART} )?{_W}|{_W}, (?:{_W}(?: \p{{L}}\.)?|\p{{L}}\.))(?![\p{{L}}\p{{M}}'’@-])")
_LOW_TOKEN = re.compile(rf"\p{{L}}\.|{_W}")
_MARKS = ".,;:!?()[]{}\"'’“”«»…—–-"
_WORDS = sre.compile(r"[^\W\d_]+")
_TITLE = re.compile(r"(?<![\p{L}&])(?:Dr|Prof|Mr|Mrs|Ms|Mx|Miss|Sir|Dame|Herrn?|Frau|Mme|Mlle|Madame|Monsieur|M|Sra?|Don|Doña|[Ss]eñora?|Rev|Professor|Doctor|Doctora?|Docteur)\.? $")
_TITLES = frozenset("dr prof mr mrs ms mx miss sir dame herr herrn frau mme mlle madame monsieur sr sra don doña señor señora rev professor doctor doctora docteur".split())
_PARTICLES = frozenset("van der den von und zu de la los las del della di da du des le ter ten d".split())


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# Classes of words, in four languages, that say whether a person is spoken of.
CLASSES: dict[str, tuple[float, frozenset[str]]] = {
    "right_verb": (2.6, _set(
        "told said says wrote writes asked asks thinks thought replied explained explains added adds argued argues lives lived works worked called calls sent signed reviewed noted who whose "
        "habite écrit explique travaille répond demande pense signale vit wohnt schreibt sagt fragt meint arbeitet erklärt antwortet lebt vive trabaja escribe dice explica pregunta responde revisó firmó opina"
    )),
    "left_verb": (2.2, _set("spoke talked wrote told asked asks met thanked thanks contact call ask dear hi hello liebe lieber cher chère querido querida estimado estimada attn attention cc signed signé firmado gez name named nom nombre heißt hieß gehört")),
    "left_prep": (0.8, _set("to with from by von an mit für zu par avec pour à de d a con por para")),
    "closer": (2.5, _set("regards sincerely yours cordialement saludos atentamente gruß grüße grüßen best cheers amitiés")),
    "place_word": (-5.0, _set(
        "street road lane avenue university college school institute museum library press county city town lake river church hospital hotel park bridge company inc ltd gmbh corp llc association society department ministry bank "
        "tech state poly christian central north south east west northern southern eastern western straße strasse platz weg rue plaza calle saint st san santa village market station house club team league cup archive edition journal review"
    )),
    "courtesy": (-5.0, _set("thanks thank regards cheers best yours dear hi hello danke merci gracias gruß grüße cordialement atentamente saludos bonjour hola hallo good bonne guten")),
    "right_kin": (-4.0, _set("son daughter sohn tochter fils fille hijo hija")),
    "left_place": (-1.5, _set("at near in bei aus nach en à chez")),
    "left_the": (-2.5, _set("the a an this that le les un une der die das el los las una")),
    "right_team": (-2.5, _set("face faces beat beats shot win wins lost winning reached")),
}
#: further class features with their prior weights
PRIORS = {
    "bias": -2.6, "title": 5.0, "agent": 3.2, "dash": 2.2, "line_end": 0.6, "mail_after": 2.0, "address_after": 1.2, "tel_after": 1.5, "label_colon": 2.0, "comma": -1.0, "caps": -0.3,
    "lower": -2.5, "part": 0.8, "three": 0.2, "long": -1.5, "initial": 0.2, "number_after": -1.0, "abbr": -4.0, "cut": -1.5,
} | {k: v[0] for k, v in CLASSES.items()}
_NAMES = list(PRIORS)
_SLOT = {n: i for i, n in enumerate(_NAMES)}
BUCKETS = 1 << 14
KNOWN = 3.6  # log-odds of a known forename: it is known for most names, and for hardly any other run of words


@dataclass
class Tagger:
    """Weights of the class features and of hashed words, the correction for unlabelled names, forenames and the lexicon."""

    forenames: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    openers: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.r_[np.array(list(PRIORS.values())), np.zeros(BUCKETS)])
    labelled_mean: float = 1.0

    def __post_init__(self) -> None:
        self.w = self.weights.tolist()

    def log_odds(self, feats: list[int], known: bool) -> float:
        s = sum(map(self.w.__getitem__, feats))
        p = min(1 / (1 + np.exp(-max(-30.0, min(30.0, s)))) / self.labelled_mean, 1 - 1e-6)
        return float(np.log(p / (1 - p))) + (KNOWN if known else 0.0)


def _hash(s: str) -> int:
    return len(_NAMES) + zlib.crc32(s.encode()) % BUCKETS


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The three tokens before and after a span; '\\n' for the end of a line, '' for the end of the text."""
    left = _CTX.findall(text[max(0, a - 48) : a])[-3:]
    right = _CTX.findall(text[b : b + 48])[:3]
    return ["", "", "", *left][-3:], [*right, "", "", ""][:3]


_CTX = sre.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]")


def features(text: str, a: int, b: int, surname: str, tokens: int, *, initial: bool, comma: bool, part: bool) -> list[int]:
    """Feature numbers of a candidate.  Neither its forename nor any word of it but the surname is among them."""
    left, right = _around(text, a, b)
    l1, l2, r1, r2 = left[2].lower(), left[1].lower(), right[0].lower(), right[1].lower()
    span = text[a:b]
    out = ["bias"]
    if _TITLE.search(text, max(0, a - 12), a):
        out.append("title")
    if l1 == "by" and l2.endswith("ed") or l1 in ("par", "von", "por") and l2[-2:] in ("é", "ée", "en", "et", "do", "da", "és"):
        out.append("agent")
    if l1 in ("—", "–") and (left[1] in ("", "\n", "-") or not left[1].isalpha()):
        out.append("dash")
    if r1 in ("", "\n") or r1 == "." and r2 in ("", "\n"):
        out.append("line_end")
    if r1 in ("<", "[") or r1 == "(" and r2 == "@":
        out.append("mail_after")
    if r1 in ("(", ",") and r2 in ("tel", "tél", "phone", "mobile", "cell"):
        out.append("tel_after")
    if r1 == "," and r2.isdigit():
        out.append("address_after")
    if r1.isdigit():
        out.append("number_after")
    if r1 == "." and right[1] and (right[1].islower() or right[1].isdigit()) and text[b : b + 1] == ".":
        out.append("abbr")
    if l1 == ":" and l2 in ("contact", "name", "from", "to", "attn", "kontakt", "nom", "nombre", "de", "von", "an", "autor", "author", "auteur", "cc"):
        out.append("label_colon")
    for flag, name in ((comma, "comma"), (part, "part"), (tokens == 3, "three"), (tokens > 4, "long"), (initial, "initial"), (span.isupper(), "caps"), (span.islower(), "lower")):
        if flag:
            out.append(name)
    C = CLASSES
    if r1 in C["right_verb"][1] or r1 in (",", "-") and r2 in ("who", "qui", "der", "die", "quien", "que") or r1 in ("a", "hat", "ha") and right[1][:1].islower():
        out.append("right_verb")
    if l1 in C["left_verb"][1] or l2 in C["left_verb"][1]:
        out.append("left_verb")
    elif l1 in C["left_prep"][1]:
        out.append("left_prep")
    near = [w.lower() for w in left if w not in ("\n", ",", "")]
    if near and near[-1] in C["closer"][1]:
        out.append("closer")
    if r1 in C["right_kin"][1] or l1 == "of" and l2 in C["right_kin"][1]:
        out.append("right_kin")
    if l1 in C["left_place"][1]:
        out.append("left_place")
    if l1 in C["left_the"][1]:
        out.append("left_the")
    if r1 in C["right_team"][1]:
        out.append("right_team")
    got = [_SLOT[n] for n in out]
    words = [w.lower() for w in _WORDS.findall(span)]
    if any(w in C["place_word"][1] for w in words):
        got.append(_SLOT["place_word"])
    if any(w in C["courtesy"][1] for w in words):
        got.append(_SLOT["courtesy"])
    low = surname.lower()
    num = lambda w: "9" if w.isdigit() else w
    l1, l2, r1, r2 = num(l1), num(l2), num(r1), num(r2)
    got += [_hash("l " + l1), _hash(f"ll {l2} {l1}"), _hash("r " + r1), _hash(f"rr {r1} {r2}"), _hash("s " + low), _hash("e3 " + low[-3:]), _hash("e4 " + low[-4:]), _hash("b3 " + low[:3])]
    return got


_ENDS = sre.compile(r"\d $")
Candidate = tuple[int, int, list[int], bool, bool]  # start, end, features, known forename, fit for training


def _one(text: str, toks: list[tuple[int, int, str, bool]], tag: Tagger, turned: bool) -> Candidate | None:
    """The candidate made of ``toks`` (start, end, word, initial), or None."""
    names = [t for t in toks if t[2] not in _PARTICLES]
    if len(names) < 2:
        return None
    given = names[1:] if turned else names[:-1]
    family = names[0] if turned else names[-1]
    if family[3] or len(family[2]) < 2:
        return None
    full = [t for t in names if not t[3]]
    known = any(t[2].lower() in tag.forenames for t in given)
    swapped = not known and not turned and family[2].lower() in tag.forenames
    a, b = toks[0][0], toks[-1][1]
    if turned:
        m = _LEAD.search(text, max(0, a - 12), a)
        a = m.start() if m else a
    surname = (names[0] if swapped else family)[2]
    f = features(text, a, b, surname, len(names), initial=len(full) < 2, comma=turned, part=len(names) < len(toks) or a < toks[0][0])
    return a, b, f, known or swapped, len(full) >= 2


def candidates(text: str, tag: Tagger) -> Iterator[Candidate]:
    """Runs that may be names; overlapping readings of one run are all given."""
    forenames, common, openers = tag.forenames, tag.common, tag.openers
    for m in RUN.finditer(text):
        # pieces of the run between common words, titles and commas
        pieces: list[list[list[tuple[int, int, str, bool]]]] = [[[]]]
        last = m.start()
        for t in _TOKEN.finditer(text, m.start(), m.end()):
            word, low = t.group(), t.group().lower()
            if "," in text[last : t.start()]:
                pieces[-1].append([])
            last = t.end()
            if t.lastgroup == "w" and (low in _TITLES or low not in forenames and (low in common and word not in _PARTICLES or word in openers)):
                pieces.append([[]])
            elif t.lastgroup == "i" and t.start() == m.start() and (word == "I." or _ENDS.search(text, max(0, m.start() - 2), m.start())):
                continue  # the unit, pronoun or figure that ends a sentence
            else:
                pieces[-1][-1].append((t.start(), t.end(), word, t.lastgroup == "i"))
        for group in pieces:
            for k, toks in enumerate(group):
                while toks and toks[0][2] in _PARTICLES:
                    toks = toks[1:]
                if len(toks) >= 3 and toks[0][2].lower() not in forenames and not toks[0][3] and toks[1][2].lower() in forenames and toks[-1] is not toks[1]:
                    got = _one(text, toks[1:], tag, False)  # a word that only begins the sentence
                else:
                    got = _one(text, toks, tag, False)
                if got:
                    yield got
                    if len(toks) >= 3 and not toks[1][3] and toks[1][2] not in _PARTICLES:
                        short = _one(text, toks[:2], tag, False)  # the next word may begin a sentence
                        if short:
                            yield short[0], short[1], [*short[2], _SLOT["cut"]], *short[3:]
                if k + 1 < len(group) and group[k + 1]:
                    back = group[k + 1]
                    if sum(t[2] not in _PARTICLES for t in toks) == 1 and not back[0][3] | (len(back) > 1 and not all(t[3] for t in back[1:])) or len(toks) == 1 and back[0][3] and all(t[3] for t in back):
                        got = _one(text, [*toks, *back], tag, True)
                        if got:
                            yield got
    rare = {w.strip(_MARKS) for w in set(text.split()) if w[:1].islower() and w not in common}
    rare = {w for w in rare if len(w) > 2 and w.islower() and w not in common}
    if rare and common and (len(rare) > 1 or not rare.isdisjoint(forenames)):
        for m in _lower_runs(text, rare):
            toks = [(t.start(), t.end(), t.group(), t.group()[-1] == ".") for t in _LOW_TOKEN.finditer(text, m.start(), m.end())]
            whole = [t for t in toks if t[2] not in _PARTICLES and not t[3]]
            if whole and all(t[2].islower() and t[2] not in common and len(t[2]) > 2 for t in whole):
                got = _one(text, toks, tag, "," in m.group())
                if got:
                    yield got


def _lower_runs(text: str, rare: set[str]) -> Iterator[re.Match]:
    """Runs of small letters that begin with a rare word, or with an initial before one."""
    for w in rare:
        at = text.find(w)
        while at >= 0:
            if not (at and text[at - 1].isalpha()):
                m = _LOW.match(text, at) or (_LOW.match(text, at - 3) if at >= 3 and text[at - 2 : at] == ". " else None)
                if m:
                    yield m
            at = text.find(w, at + len(w))


def find_names(text: str, tag: Tagger, taken: bytearray) -> list[tuple[int, int]]:
    """Spans of names, the best-scored first where two overlap, then the longer, then the earlier."""
    scored = []
    for a, b, f, known, _ in candidates(text, tag):
        if not any(taken[a:b]):
            s = tag.log_odds(f, known)
            if s > 0:
                scored.append((-s, a - b, a, b))
    out = []
    for _, _, a, b in sorted(scored):
        if not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b))
    return out


def _sums(at: np.ndarray, size: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probabilities, gradient, loss) of candidates whose feature numbers stand one after another in ``at``, so many of each."""
    row = np.repeat(np.arange(len(size)), size)
    z = np.clip(np.bincount(row, weights=w[at], minlength=len(size)), -30, 30)
    p = 1 / (1 + np.exp(-z))
    return p, np.bincount(at, weights=(p - y)[row], minlength=len(w)), float((np.logaddexp(0, z) - y * z).sum())


def fit_weights(total: Callable[[np.ndarray], tuple[np.ndarray, float]], n: int, seen: np.ndarray, l2: float = 0.02, steps: int = 300, tolerance: float = 1e-4, memory: int = 10) -> np.ndarray:
    """Logistic weights, shrunk towards the prior means, by L-BFGS; ``total`` gives gradient and loss summed over all ``n`` candidates,
    ``seen`` says how many have a feature.  It ends where no scaled slope is above ``tolerance``."""
    prior = np.r_[np.array(list(PRIORS.values())), np.zeros(BUCKETS)]
    if not n:
        return prior
    reg = l2 * np.where(np.arange(len(prior)) < len(_NAMES), 0.3, 1.0) / 10
    scale = np.where(seen >= 3, 1 / np.sqrt(0.25 * seen / n + reg), 0.0)  # what was hardly ever seen says nothing

    def at(u: np.ndarray) -> tuple[np.ndarray, float]:
        g, loss = total(prior + scale * u)
        return scale * (g / n + reg * scale * u), loss / n + float((reg * (scale * u) ** 2).sum()) / 2

    u = np.zeros(len(prior))
    g, loss = at(u)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < tolerance:
            break
        d, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ d) / (s @ y))
            d -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            d += (alpha - (y @ d) / (s @ y)) * s
        rate = 1.0
        while True:
            new, (new_g, new_loss) = u - rate * d, at(u - rate * d)
            if new_loss <= loss - 1e-4 * rate * (g @ d) or rate < 1e-6:
                break
            rate /= 2
        s, y = new - u, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        stuck = rate < 1e-6
        u, g, loss = new, new_g, new_loss
        if stuck:
            break
    return prior + scale * u


_CASED = re.compile(r"(?P<open>(?:^|[.!?;:»”\"]\s+|\n\s*(?:[-–—*] )?)?)(?P<w>\p{L}+)")


_URL = sre.compile(r"https?://\S+|@\w+")


def _word_counts(texts: list[str]) -> dict[str, list[int]]:
    """For each word the number of texts that have it in small letters, otherwise, and of these those where it always opens a sentence."""
    out: dict[str, list[int]] = {}
    for t in texts:
        for a, b in reversed(list(emails(t))):  # the words of an address are no words of the language
            t = t[:a] + t[b:]
        t = _URL.sub("", t)
        low, begin = set(), {}
        for opens, w in _CASED.findall(t):
            if w.islower():
                low.add(w)
            else:
                begin[w] = begin.get(w, True) and (bool(opens) or t.startswith(w))
        for w in low:
            out.setdefault(w, [0, 0, 0])[0] += 1
        for w, first in begin.items():
            n = out.setdefault(w, [0, 0, 0])
            n[1] += 1
            n[2] += first
    return out


def lexicon(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(words of the language, words that only open sentences) of all of the distinct ``texts(t)``.

    A word of the language stands in small letters in five texts and in a fifth of its texts at least; an opener is
    capitalised in five texts and nearly always where a sentence begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _word_counts(b.column(0).to_pylist())
            words = list(got)
            counts = [pa.array([got[w][k] for w in words], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([w.lower() for w in words], pa.string()), *counts], ["w", "low", "n_low", "n_up", "n_first"])

    per = texts.mapInArrow(run, "w string, low string, n_low bigint, n_up bigint, n_first bigint").groupBy("w", "low").agg(*[F.sum(c).alias(c) for c in ("n_low", "n_up", "n_first")])
    both = per.groupBy("low").agg(
        F.sum("n_up").alias("caps"), F.sum(F.when(F.col("w") == F.col("low"), F.col("n_low")).otherwise(0)).alias("n"),
        F.collect_list(F.when((F.col("n_up") >= 5) & (F.col("n_first") >= 0.85 * F.col("n_up")), F.col("w"))).alias("openers"),
    )
    common = (F.col("n") >= 5) & (F.col("n") >= 0.2 * (F.col("n") + F.col("caps")))
    got = both.select("low", common.alias("common"), "openers").filter(F.col("common") | (F.size("openers") > 0)).collect()  # words of the language, not rows
    return frozenset(r["low"] for r in got if r["common"]), frozenset(w for r in got for w in r["openers"])


def fit_tagger(df: DataFrame, key: str, text: str, forenames: frozenset[str], *, least: int = 30) -> Tagger:
    """A tagger for the texts of ``df``, fitted on all of them, each distinct text once.

    The candidates' feature numbers are packed into blocks and written once; the fits pass over these blocks, and only sums come
    to the driver.  With fewer than ``least`` labelled candidates the prior is kept."""
    texts = cut_lineage(df.filter(F.length(text) > 0).select(F.col(text).alias("t")).distinct())
    tag = Tagger(forenames, *lexicon(texts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(f, known) for t in b.column(0).to_pylist() for _, _, f, known, fit in candidates(t, tag) if fit]
            if got:
                yield _block(np.fromiter((x for f, _ in got for x in f), dtype=np.uint16), [len(f) for f, _ in got], [k for _, k in got], [k for _, k in got])

    blocks = cut_lineage(texts.mapInArrow(pack, _BLOCK))
    few = max(1, min(blocks.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism))
    found = _passes(blocks.coalesce(few), lambda at, size, y, target: (np.bincount(at, minlength=len(tag.weights)), [len(y), y.sum()]))
    if found is None or found[1][1] < least:
        return tag
    seen, (n, labelled) = found[0], found[1]
    for turn in range(2):  # unlabelled candidates that the first fit takes for names are no negatives in the second
        now = blocks.coalesce(few)
        w = fit_weights(lambda w: (lambda g, x: (g, x[0]))(*_passes(now, lambda at, size, y, target: (lambda p, g, loss: (g, [loss]))(*_sums(at, size, target, w)))), int(n), seen)  # noqa: B023
        mean = _labelled_mean(_passes(now, lambda at, size, y, target: (np.zeros(1), [_sums(at, size, y, w)[0][y == 1].sum()]))[1][0] / labelled)  # noqa: B023

        def retarget(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, mean: float = mean) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, size, y, _ in _unpacked(b):
                    yield _block(at, size, y, np.where(_sums(at, size, y, w)[0] / mean > 0.5, 1, y))

        if not turn:
            blocks = cut_lineage(blocks.mapInArrow(retarget, _BLOCK))
    return Tagger(tag.forenames, tag.common, tag.openers, w, mean)


_BLOCK = "at binary, size binary, y binary, target binary"


def _block(at, size, y, target) -> pa.RecordBatch:
    """Candidates: all of their feature numbers, how many each has, whether it is known, and what it counts as."""
    cols = [np.asarray(x, dtype=k).tobytes() for x, k in zip((at, size, y, target), (np.uint16, np.uint16, np.uint8, np.uint8))]
    return pa.RecordBatch.from_pydict({c.split(" ")[0]: pa.array([v], pa.binary()) for c, v in zip(_BLOCK.split(", "), cols)})


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for row in zip(*[b.column(i) for i in range(4)]):
        yield tuple(np.frombuffer(x.as_buffer(), dtype=k) for x, k in zip(row, (np.uint16, np.uint16, np.uint8, np.uint8)))


def _passes(blocks: DataFrame, sums: Callable[..., tuple[np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray] | None:
    """The totals of ``sums(at, size, y, target)`` over all blocks: a vector and some numbers, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, numbers = 0, 0
        for b in batches:
            for block in _unpacked(b):
                v, x = sums(*block)
                vector, numbers = vector + v, numbers + np.asarray(x, dtype=np.float64)
        if not np.isscalar(vector):
            yield pa.RecordBatch.from_pydict({k: pa.array([np.asarray(x, dtype=np.float64).tobytes()], pa.binary()) for k, x in (("v", vector), ("x", numbers))})

    rows = blocks.mapInArrow(run, "v binary, x binary").collect()  # one row a task
    return tuple(sum(np.frombuffer(r[k]) for r in rows) for k in ("v", "x")) if rows else None


def _labelled_mean(mean: float) -> float:
    return float(min(1.0, max(0.2, mean)))


def fit_on(feats: list[list[int]], y: np.ndarray, tag: Tagger) -> Tagger:
    """As :func:`fit_tagger`, for candidates in memory."""
    at = np.fromiter((x for f in feats for x in f), dtype=np.int64)
    size, target = np.array([len(f) for f in feats]), y
    seen = np.bincount(at, minlength=len(tag.weights))
    for _ in range(2):
        w = fit_weights(lambda w: _sums(at, size, target, w)[1:], len(y), seen)  # noqa: B023
        p = _sums(at, size, y, w)[0]
        mean = _labelled_mean(p[y == 1].mean())
        target = np.where(p / mean > 0.5, 1.0, y)
    return Tagger(tag.forenames, tag.common, tag.openers, w, mean)
