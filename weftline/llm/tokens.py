"""Encoding of a whole corpus with a public tokenizer, and back.

The ``tokenizers`` library encodes Arrow batches of texts.  A byte-level vocabulary writes each byte of
the UTF-8 form as one printable character; the table of those characters, reversed, turns any run of
ids back into bytes, so that characters split over several tokens come back whole.

Defined results
---------------
* an empty text and a null text both have the empty list of ids (never null);
* strings that look like special tokens are ordinary text; no special token is added;
* texts of any length are encoded whole; equal texts of a batch are encoded once;
* decoding an incomplete character (a cut list of ids) yields U+FFFD for what is missing;
* extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: where the public vocabulary files lie unless a caller names another place
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: the same vocabulary as ranks, for counting alone
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file along with the job: executors need no copy of their own."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def _local(path: str) -> str:
    """The file's place on this machine: as named, or as shipped."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def _counter(path: str):
    import base64

    import tiktoken

    with open(_local(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counter", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _fold(width: int) -> np.ndarray:
    """Token id -> one of ``width`` buckets, the same everywhere."""
    return np.random.default_rng(4711).integers(0, width, 1 << 18)


def count_and_fold(texts: list[str], path: str = DEFAULT_RANKS, width: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """(number of tokens of each text, counts of their ids folded into ``width`` buckets).  Equal texts are encoded once."""
    t = _counter(path)
    slot: dict[str, int] = {}
    at = np.array([slot.setdefault(x, len(slot)) for x in texts], dtype=np.int64)
    ids = [t.encode_ordinary(x) for x in slot]
    sizes = np.array([len(i) for i in ids], dtype=np.int64)
    if not width:
        return sizes[at], None
    counts = np.zeros((len(ids), width), dtype=np.float32)
    fold = _fold(width)
    for k, i in enumerate(ids):
        counts[k] = np.bincount(fold[i], minlength=width)
    return sizes[at], counts[at]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One tokenizer per Python process; threads are left to Spark."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_local(path))
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """Byte -> the printable character that stands for it: printable Latin-1 bytes stand for themselves, the rest move up from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    spare = 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


@lru_cache(maxsize=4)
def id_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    back = {c: b for b, c in byte_characters().items()}
    t = tokenizer(path)
    out = [b""] * t.get_vocab_size()
    for tok, i in t.get_vocab().items():
        out[i] = bytes(back[c] for c in tok) if all(c in back for c in tok) else tok.encode("utf-8")
    return out


def decode_ids(ids, path: str = DEFAULT_VOCABULARY) -> str:
    """The text of a list of ids."""
    table = id_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def _encode(texts: list[str | None], path: str, offsets: bool):
    """Flat ids, lengths (and flat start/end offsets in code points) of a batch; each distinct text is encoded once."""
    t = tokenizer(path)
    slot: dict[str, int] = {}
    at = [slot.setdefault(x, len(slot)) if x else -1 for x in texts]
    encode = t.encode_batch if offsets else getattr(t, "encode_batch_fast", t.encode_batch)
    done = encode(list(slot), add_special_tokens=False) if slot else []
    ids = [np.asarray(e.ids, dtype=np.int32) for e in done]
    spans = [np.asarray(e.offsets, dtype=np.int32).reshape(-1, 2) for e in done] if offsets else None
    empty, none = np.empty(0, np.int32), np.empty((0, 2), np.int32)
    per = [ids[k] if k >= 0 else empty for k in at]
    sizes = np.fromiter((len(p) for p in per), dtype=np.int64, count=len(per))
    flat = np.concatenate(per) if per else empty
    where = np.concatenate([spans[k] if k >= 0 else none for k in at]) if offsets and per else none
    return flat, sizes, where


def _list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))


def encode_corpus(df: DataFrame, key: str, text: str, *, path: str = DEFAULT_VOCABULARY, offsets: bool = False, block_chars: int = 2_000_000) -> DataFrame:
    """``(key, ids)``, with ``offsets`` also ``starts`` and ``ends`` of each token in code points of the text."""
    shipped(df.sparkSession, path)
    src = df.select(F.col(key), F.col(text).alias("_text"))
    fields = [src.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            a = 0
            while a < len(texts):  # blocks bound the memory that very long texts take
                z, size = a, 0
                while z < len(texts) and (z == a or size + len(texts[z] or "") <= block_chars):
                    size += len(texts[z] or "")
                    z += 1
                flat, sizes, where = _encode(texts[a:z], path, offsets)
                cols = [b.column(0).slice(a, z - a), _list_array(flat, sizes)]
                if offsets:
                    cols += [_list_array(np.ascontiguousarray(where[:, k]), sizes) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])
                a = z

    return src.mapInArrow(run, T.StructType(fields))


def count_tokens(df: DataFrame, text: str, *, path: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text`` (0 for null and empty); an existing column ``name`` is replaced."""
    pos = [*df.columns].index(text)
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, sizes, _ = _encode(b.column(pos).to_pylist(), path, False)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes)], [*keep, name])

    return df.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str, ids: str, *, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, text)`` out of lists of ids; a null list has a null text."""
    src = df.select(F.col(key), F.col(ids).alias("_ids"))
    schema = T.StructType([src.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode_ids(x, path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return src.mapInArrow(run, schema)
