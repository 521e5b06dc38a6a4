"""Free-typed values mapped to the closest entry of a reference list.

Each distinct typed value is taken apart once: remarks and uncertainty marks go, a part that names (or
abbreviates) a context of the reference, such as a district, is set aside, and the rest becomes one or
two spellings.  Spellings and the reference's variants are compared as sets of padded q-grams by the
prefix-filter join of :mod:`weftline.llm.setsim`; the exact Jaccard similarity, the edit distance and
the context choose the best entry.

Defined results
---------------
* null and blank values are no values and give no row;
* a value close to no entry, or to entries of another context only, maps to ``NONE`` (-1);
* among equally good entries the one of the named context wins, then the nearer spelling, then the smallest id;
* repeated values share one comparison; the mapping is a function of the typed value alone;
* an empty reference maps everything to -1; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.setsim import set_similarity_join
from weftline.llm.unicode_form import bare
from weftline.session import cut_lineage

NONE = -1


@dataclass(frozen=True)
class Parsing:
    """How typed values are taken apart.  ``remarks`` are words that say nothing about which entry is meant."""

    remarks: frozenset[str] = frozenset()
    separators: str = r"[,:;()\[\]{}?!/|]+"
    folds: tuple[tuple[str, str], ...] = ()
    min_context: int = 3
    q: int = 2


#: remarks and spelling habits of place names (fixed values)
PLACES = Parsing(
    remarks=frozenset(
        "near kome vermutlich village of from prov prob sic the in at bei nahe aus dorf town city probably perhaps "
        "presumably wohl ca circa provenance prope vicus".split()
    ),
    folds=(("ph", "f"), ("kh", "ch"), ("ei", "i"), ("u", "y"), ("ks", "x")),
)


fold = bare


def respell(word: str, p: Parsing) -> str:
    for a, b in p.folds:
        word = word.replace(a, b)
    return word


def grams(word: str, q: int) -> list[str]:
    """Padded q-grams; the n-th copy of a gram is a token of its own, so that a set keeps what a bag would."""
    s = "^" * (q - 1) + word + "$" * (q - 1)
    seen: Counter = Counter()
    out = []
    for i in range(len(s) - q + 1):
        g = s[i : i + q]
        seen[g] += 1
        out.append(g if seen[g] == 1 else f"{g}#{seen[g]}")
    return out


def take_apart(value: str, contexts: Sequence[str], p: Parsing) -> tuple[list[str], str | None, bool]:
    """(spellings, context, cut): ``cut`` tells that the last word is abbreviated by a full stop."""
    text = fold(value)
    context: str | None = None
    words: list[str] = []
    for seg in re.split(p.separators, text):
        own = [w for w in seg.split() if w.strip(".-'\"") and w.strip(".-'\"") not in p.remarks]
        if len(own) == 1 and context is None:
            stem = own[0].strip(".")
            long_enough = len(stem) >= (p.min_context if own[0].endswith(".") else p.min_context + 2)
            hits = [c for c in contexts if c.startswith(stem)] if long_enough else []
            if len(hits) == 1:
                context = hits[0]
                continue
        words += own
    cut = bool(words) and words[-1].endswith(".")
    clean = [re.sub(r"[^\w]", "", w) for w in words]
    if not any(clean):
        return [], context, False
    spellings = []
    for plain in ([respell(w, p) for w in clean if w], [w for w in clean if w]):  # a respelled and an untouched form
        spellings.append("".join(plain))
        if len(plain) > 1:
            spellings.append("".join(plain[-1:] + plain[:-1]))
            cut = cut or words[0].endswith(".")
    return list(dict.fromkeys(spellings)), context, cut


def entry_variants(name: str, p: Parsing, min_cut: int = 4) -> list[tuple[str, str]]:
    """(variant, kind) of a reference name: 'full', 'short' (first word as an initial), 'cut' (last letters left off)."""
    clean = [w for w in (re.sub(r"[^\w]", "", w) for w in fold(name).split()) if w]
    if not clean:
        return []
    full: list[tuple[str, str]] = []
    cut: list[tuple[str, str]] = []
    for words in ([respell(w, p) for w in clean], clean):
        stems = ["".join(words)]
        full.append((stems[0], "full"))
        if len(words) > 1:
            stems.append(words[0][0] + "".join(words[1:]))
            full.append((stems[1], "short"))
        for s in stems:
            cut += [(s[:k], "cut") for k in range(min_cut, len(s) - 1)]
    return list(dict.fromkeys(full + cut))


def map_to_canonical(
    values: DataFrame, value: str, ref: DataFrame, ref_id: str, names: Sequence[str], context: str | None = None, *,
    parsing: Parsing = PLACES, t: float = 0.4, max_contexts: int = 10_000,
) -> DataFrame:
    """``(value, ref_id, jaccard, distance)`` for every distinct non-blank value; ``ref_id`` is -1 where no entry is meant.

    ``names`` are the reference's name columns, ``context`` its district-like column, whose distinct values
    (at most ``max_contexts``, else an error) are known to the parser.
    """
    contexts: list[str] = []
    if context:
        rows = ref.select(context).filter(F.col(context).isNotNull()).distinct().limit(max_contexts + 1).collect()
        if len(rows) > max_contexts:
            raise ValueError(f"more than {max_contexts} contexts")
        contexts = sorted({fold(r[0]) for r in rows})
    q = parsing.q

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for v in b.column(0).to_pylist():
                spellings, ctx, cut = take_apart(v, contexts, parsing)
                for s in spellings or [""]:
                    for c, x in zip(cols, (v, s, ctx, cut, grams(s, q) if s else [])):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_()),
                 pa.array(cols[4], pa.list_(pa.string()))], ["val", "spelling", "ctx", "cut", "toks"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[], [], [], [], []]
            for i, ctx, *own in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)]):
                for name in own:
                    for variant, kind in entry_variants(name, parsing) if name else ():
                        for c, x in zip(cols, (i, fold(ctx) if ctx else None, variant, kind, grams(variant, q))):
                            c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()),
                 pa.array(cols[4], pa.list_(pa.string()))], ["ref", "rctx", "variant", "kind", "toks"])

    distinct = values.select(F.col(value).alias("val")).filter(F.col("val").rlike(r"[^\s\p{Z}\p{C}]")).groupBy("val").agg(F.count("*").alias("_n")).select("val")
    mine = cut_lineage(distinct.mapInArrow(typed, "val string, spelling string, ctx string, cut boolean, toks array<string>"))  # parsed once
    src = ref.select(F.col(ref_id).cast("bigint"), (F.col(context) if context else F.lit(None)).cast("string"), *[F.col(n).cast("string").alias(f"n{i}") for i, n in enumerate(names)])
    theirs = cut_lineage(src.filter(F.col(ref_id).isNotNull()).mapInArrow(listed, "ref bigint, rctx string, variant string, kind string, toks array<string>"))
    # spellings and variants are joined as distinct strings; ids of any number may stand behind one variant
    pairs = set_similarity_join(
        mine.filter("spelling <> ''").select(F.col("spelling").alias("id"), "toks"), theirs.select(F.col("variant").alias("id"), "toks"), t
    )
    dist = F.levenshtein("left_id", "right_id")
    room = F.when(F.length("right_id") >= 9, 3).when(F.length("right_id") >= 6, 2).otherwise(1)
    near = pairs.withColumn("distance", dist).filter(F.col("distance") <= room)
    hits = (
        mine.filter("spelling <> ''").select("val", "spelling", "ctx", "cut")
        .join(near, F.col("spelling") == F.col("left_id"))
        .join(theirs.select("ref", "rctx", "variant", "kind"), F.col("right_id") == F.col("variant"))
        .filter((F.col("kind") != "cut") | (F.col("cut") & (F.col("distance") <= 1)))
        .filter(F.col("ctx").isNull() | F.col("rctx").isNull() | (F.col("ctx") == F.col("rctx")))
    )
    rank = F.struct((F.col("kind") == "cut").alias("cut"), "distance", (-F.col("jaccard")).alias("far"), "ref", "jaccard")
    best = hits.groupBy("val").agg(F.min(rank).alias("b"))
    return mine.select("val").distinct().join(best, "val", "left").select(
        F.col("val").alias(value), F.coalesce("b.ref", F.lit(NONE)).cast("bigint").alias(ref_id), F.col("b.jaccard").alias("jaccard"), F.col("b.distance").alias("distance")
    )
