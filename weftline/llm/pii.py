"""Private details of living people in free text: found, and replaced by typed, format-preserving pseudonyms.

Numbers, mail and street addresses are found by their form and validated (plans of countries, check digits and letters,
labels: ``pii_forms``); names by a tagger that is trained on weak labels of a bounded sample (``name_tagger``).  A detail is
replaced by a placeholder of its kind: validated numbers and dates of birth go through keyed Feistel permutations within
their format (``pseudonyms``), other details get a keyed digest.  Equal values have equal pseudonyms in every document,
however a number is dialled or a name is turned; ``unmask_text`` takes numbers and dates back with the key.

Defined results
---------------
* null and empty texts hold nothing and stay as they are; texts of any length are read whole;
* positions are code points from 0, the end excluded; spans never overlap: of two that would, the one whose kind
  comes first in ``KINDS`` stays, then the better-scored or earlier, then the longer;
* inventory, game and catalogue numbers, user handles, ancient persons, teams and places are no details;
* repeated texts give the same spans; without forenames, or with too few weak labels, the tagger's prior finds names;
* dates are masked only where a text calls them a birth; they are no kind of ``detect_details``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import pii_forms as P
from weftline.llm.name_tagger import Tagger, find_names
from weftline.llm.pseudonyms import stand_in

KINDS = ("email", "id_number", "phone", "address", "name")
_FORMS = (("email", P.emails), ("id_number", P.id_numbers), ("phone", P.phones), ("address", P.addresses))
_INSIDE = re.compile(r"https?://\S+|(?<![\p{L}\p{N}_.+-])@[\p{L}\p{N}_]+")


def find_details(text: str | None, tagger: Tagger, dates: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every detail of a text, in order of position; with ``dates`` also dates of birth."""
    if not text:
        return []
    taken = bytearray(len(text))
    for m in _INSIDE.finditer(text) if "@" in text or "://" in text else ():
        taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    out: list[tuple[str, int, int]] = []
    for kind, spans in (*_FORMS, ("date", P.birth_dates)) if dates else _FORMS:
        for a, b in spans(text):
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((kind, a, b))
    out += [("name", a, b) for a, b in find_names(text, tagger, taken)]
    out.sort(key=lambda x: x[1])
    return out


def mask_text(text: str | None, tagger: Tagger, key: bytes) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in find_details(text, tagger, dates=True):
        out += [text[at:a], f"[{kind.upper()} {stand_in(kind, text[a:b], key)}]"]
        at = b
    return "".join([*out, text[at:]])


_MASKED = re.compile(r"\[(PHONE|ID_NUMBER|DATE) ([^\[\]]*)\]")


def unmask_text(text: str | None, key: bytes) -> str | None:
    """Numbers and dates as they were; digests stay, since they can't be undone."""
    return _MASKED.sub(lambda m: stand_in(m[1].lower(), m[2], key, True), text) if text else text


# -- operators -------------------------------------------------------------------------------------------------------------------


def forename_set(df: DataFrame, col: str, max_rows: int = 1_000_000) -> frozenset[str]:
    """The list of forenames, case-folded.  It is a fixed list; its size is checked."""
    rows = df.select(F.lower(F.trim(F.col(col))).alias("g")).filter("g <> ''").distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} forenames")
    return frozenset(r["g"] for r in rows)


def detect_details(df: DataFrame, key: str, text: str, tagger: Tagger) -> DataFrame:
    """``(key, kind, span_start, span_end)``: one row per detail of every text."""
    src = df.select(F.col(key), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = T.StructType([src.schema[key], T.StructField("kind", T.StringType()), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            found: list[tuple[str, int, int]] = []
            seen: dict[str, list[tuple[str, int, int]]] = {}
            for i, t in enumerate(b.column(1).to_pylist()):
                got = seen.get(t)
                if got is None:
                    got = seen[t] = find_details(t, tagger)
                rows += [i] * len(got)
                found += got
            cols: Sequence = [b.column(0).take(pa.array(rows, pa.int64()))]
            cols += [pa.array([x[k] for x in found], t) for k, t in ((0, pa.string()), (1, pa.int32()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    return src.mapInArrow(run, schema)


def _rewrite(df: DataFrame, key: str, text: str, write) -> DataFrame:
    src = df.select(F.col(key), F.col(text).alias("_text"))
    schema = T.StructType([src.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            done = {t: write(t) for t in set(texts)}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([done[t] for t in texts], pa.string())], [key, "text"])

    return src.mapInArrow(run, schema)


def mask_details(df: DataFrame, key: str, text: str, tagger: Tagger, secret: bytes) -> DataFrame:
    """``(key, text)`` with every detail replaced by its placeholder; null and empty texts as they were."""
    return _rewrite(df, key, text, lambda t: mask_text(t, tagger, secret))


def unmask_details(df: DataFrame, key: str, text: str, secret: bytes) -> DataFrame:
    """``(key, text)`` with the placeholders of numbers and dates replaced by what they stand for."""
    return _rewrite(df, key, text, lambda t: unmask_text(t, secret))
