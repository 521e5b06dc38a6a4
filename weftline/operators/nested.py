"""Deeply nested JSON to flat, linked rows by vectorised structural indexing.

A whole Arrow batch of JSON texts is treated as one byte array.  NumPy builds the bitmaps of
unescaped quotes and of brackets and delimiters outside strings, nesting depth comes from prefix
sums, parents from a search among the openers one level up, and the spans of keys and values from
the neighbouring structural bytes.  No per-row parser runs; the cost is linear in the bytes.

Defined results
---------------
* a text that is not one whole JSON value (empty, cut off, trailing bytes, bad escapes, bare words)
  gives no node at all; so does a null text; ``null``, ``7`` or ``"x"`` are whole but hold no object;
* elements of an array that are no objects keep their positions but give no row;
* for a key named in ``lone`` an object that stands where an array is usual counts as element 0;
* for a key named in ``embedded`` a string value that is itself whole JSON counts as if it stood open;
* repeated rows give repeated nodes; a key met twice in one object gives its nodes twice;
* other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdefABCDEF"]] = True
_ESCAPES = np.zeros(256, dtype=bool)
_ESCAPES[[*b'"\\/bfnrtu']] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*b" \t\n\r"]] = True
_STRUCT = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(b"{}[]:,", 1):
    _STRUCT[_c] = _i
_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COLON, _COMMA, _STR, _SCALAR = range(1, 9)

# what may follow what: token kinds as above, 0 stands for the start and end of the text; the kind of container
# that is open decides between the two meanings of a comma, so rows are (previous token, container) and columns the next
_FOLLOW = np.zeros((9, 3, 9), dtype=bool)  # [previous, container: 0 none, 1 object, 2 array, next]
_VALUES = [_OPEN_O, _OPEN_A, _STR, _SCALAR]
_FOLLOW[0, 0, _VALUES] = True
_FOLLOW[_OPEN_O, 1, [_STR, _CLOSE_O]] = True
_FOLLOW[_OPEN_A, 2, [*_VALUES, _CLOSE_A]] = True
_FOLLOW[_COLON, 1, _VALUES] = True
_FOLLOW[_COMMA, 1, _STR] = True
_FOLLOW[_COMMA, 2, _VALUES] = True
for _p in (_CLOSE_O, _CLOSE_A, _STR, _SCALAR):
    _FOLLOW[_p, 0, 0] = True
    _FOLLOW[_p, 1, [_COMMA, _CLOSE_O]] = True
    _FOLLOW[_p, 2, [_COMMA, _CLOSE_A]] = True


class Index:
    """Structural index of many JSON texts: tokens (kind, place, text, depth, container) and a flag per text whether it is whole."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        start = np.zeros(len(texts), dtype=np.int64)
        np.cumsum(lens[:-1] + 1, out=start[1:]) if len(texts) > 1 else None
        end = start + lens
        self.buf, self.start, self.end = buf, start, end
        n = len(texts)
        bad = lens == 0
        doc_of = lambda at: np.searchsorted(start, at, side="right") - 1

        # quotes that no odd run of backslashes escapes
        slash = np.flatnonzero(buf == 92)
        escaped = np.empty(0, dtype=np.int64)
        if len(slash):
            new_run = np.r_[True, np.diff(slash) != 1]
            run_start = slash[np.maximum.accumulate(np.where(new_run, np.arange(len(slash)), 0))]
            lead = slash[(slash - run_start) % 2 == 0]  # the backslashes that open an escape
            escaped = lead + 1
        quote = np.flatnonzero(buf == 34)
        if len(escaped):
            quote = quote[~np.isin(quote, escaped, assume_unique=True)]
        qdoc = doc_of(quote)
        count = np.bincount(qdoc, minlength=n)
        before = np.concatenate([[0], np.cumsum(count)])[:-1]
        opening = (np.arange(len(quote)) - before[qdoc]) % 2 == 0
        bad |= count % 2 == 1
        keep = ~bad[qdoc]
        q_open, q_close = quote[opening & keep], quote[~opening & keep]
        inside = np.zeros(len(buf) + 1, dtype=np.int8)  # prefix sum of openers and closers: 1 within strings
        inside[q_open] += 1
        inside[q_close] -= 1
        within = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        if len(escaped):
            wrong = ~_ESCAPES[buf[escaped]] | ~within[escaped]
            bad[np.unique(doc_of(escaped[wrong]))] = True
            u = escaped[buf[escaped] == 117]
            if len(u):  # four hexadecimal digits must follow
                four = np.minimum(u[:, None] + np.arange(1, 5), len(buf) - 1)
                bad[np.unique(doc_of(u[~_HEX[buf[four]].all(axis=1)]))] = True
        control = np.flatnonzero((buf < 32) & within)
        if len(control):
            bad[np.unique(doc_of(control))] = True

        # structural bytes outside strings, and scalars: runs of other bytes
        kind_at = _STRUCT[buf]
        kind_at[within] = 0
        structural = np.flatnonzero(kind_at)
        other = (kind_at == 0) & ~within & ~_SPACE[buf]
        other[q_close] = False
        s_open = np.flatnonzero(other & ~np.r_[False, other[:-1]])
        s_close = np.flatnonzero(other & ~np.r_[other[1:], False])
        place = np.concatenate([structural, q_open, s_open])
        stop = np.concatenate([structural, q_close, s_close])
        kind = np.concatenate([kind_at[structural], np.full(len(q_open), _STR, np.uint8), np.full(len(s_open), _SCALAR, np.uint8)])
        order = np.argsort(place, kind="stable")
        place, stop, kind = place[order], stop[order], kind[order]
        doc = doc_of(place)
        self._check_scalars(place, stop, kind, doc, bad)

        # depth by prefix sums, per text
        step = np.where((kind == _OPEN_O) | (kind == _OPEN_A), 1, 0) - np.where((kind == _CLOSE_O) | (kind == _CLOSE_A), 1, 0)
        depth = np.cumsum(step)
        first = np.searchsorted(doc, np.arange(n))
        has = np.bincount(doc, minlength=n) > 0
        bad |= ~has
        base = np.zeros(n, dtype=np.int64)
        base[has] = depth[first[has]] - step[first[has]]
        depth = depth - base[doc]
        last = np.searchsorted(doc, np.arange(n), side="right") - 1
        bad[has] |= depth[last[has]] != 0
        np.logical_or.at(bad, doc[depth < 0], True)
        keep = ~bad[doc]
        place, stop, kind, doc, depth, step = (a[keep] for a in (place, stop, kind, doc, depth, step))

        # container of each token: the last opener one level up
        opens = np.flatnonzero(step == 1)
        level = np.where(step == 1, depth - 1, depth)  # the level a token stands on; closers stand on their opener's level
        container = np.full(len(place), -1, dtype=np.int64)
        by = opens[np.argsort(depth[opens], kind="stable")]
        key_depth = depth[by]
        for d in np.unique(level[level > 0]):
            a, b = np.searchsorted(key_depth, [d, d + 1])
            own = np.flatnonzero(level == d)
            lane = by[a:b]
            container[own] = lane[np.searchsorted(lane, own) - 1]
        closes = np.flatnonzero(step == -1)
        match = np.full(len(place), -1, dtype=np.int64)  # a closer's opener
        for d in np.unique(level[closes]) if len(closes) else ():
            a, b = np.searchsorted(key_depth, [d + 1, d + 2])
            own = closes[level[closes] == d]
            lane = by[a:b]
            match[own] = lane[np.searchsorted(lane, own) - 1]
        wrong = closes[(kind[match[closes]] == _OPEN_O) != (kind[closes] == _CLOSE_O)]
        np.logical_or.at(bad, doc[wrong], True)

        # grammar: each pair of neighbours must be allowed in the container that is open between them
        m = len(place)
        if m:
            prev = np.r_[0, kind[:-1]]
            fresh = np.r_[True, doc[1:] != doc[:-1]]
            prev[fresh] = 0
            inner = container.copy()  # the container open just before a token: a closer still stands in the one it ends
            inner[closes] = match[closes]
            box = np.where(inner < 0, 0, np.where(kind[inner] == _OPEN_O, 1, 2))
            ok = _FOLLOW[prev, box, kind]
            final = np.r_[doc[1:] != doc[:-1], True]
            ok &= ~final | (_FOLLOW[kind, 0, 0] & (level == 0))
            # in an object a string is a key after { or , and must be followed by a colon; a colon follows nothing else
            nxt = np.r_[kind[1:], 0]
            nxt[final] = 0
            is_key = (kind == _STR) & (box == 1) & ((prev == _OPEN_O) | (prev == _COMMA))
            ok |= (kind == _COLON) & (box == 1) & np.r_[False, is_key[:-1]]
            ok &= ~is_key | (nxt == _COLON)
            np.logical_or.at(bad, doc[~ok], True)
        else:
            is_key = np.zeros(0, dtype=bool)
        self.whole = ~bad
        keep = self.whole[doc]
        new = np.cumsum(keep) - 1
        renum = lambda a: np.where(a >= 0, new[a], -1)[keep]
        self.container, self.match = renum(container), renum(match)
        self.place, self.stop, self.kind, self.doc, self.level, self.is_key = (a[keep] for a in (place, stop, kind, doc, level, is_key))

    def _check_scalars(self, place, stop, kind, doc, bad) -> None:
        at = np.flatnonzero(kind == _SCALAR)
        size = stop[at] - place[at] + 1
        known: dict[bytes, bool] = {b"true": True, b"false": True, b"null": True}
        for w in np.unique(size):
            own = at[size == w]
            if w > 64:
                texts = np.array([bytes(self.buf[place[i] : stop[i] + 1]) for i in own], dtype=object)
                good = np.array([bool(_NUMBER.match(t)) for t in texts], dtype=bool)
            else:  # texts of one width lie in a matrix; each distinct one is judged once
                rows = np.ascontiguousarray(self.buf[place[own][:, None] + np.arange(w)]).view(f"V{w}").ravel()
                uniq, inv = np.unique(rows, return_inverse=True)
                judged = np.array([known.get(u.tobytes()) or bool(_NUMBER.match(u.tobytes())) for u in uniq], dtype=bool)
                good = judged[inv]
            np.logical_or.at(bad, doc[own[~good]], True)

    def text(self, i: int) -> bytes:
        return self.buf[self.place[i] : self.stop[i] + 1].tobytes()


def _strings(ix: Index, at: np.ndarray) -> np.ndarray:
    """Decoded texts of string tokens; each distinct token is decoded once."""
    out = np.empty(len(at), dtype=object)
    size = ix.stop[at] - ix.place[at] + 1
    for w in np.unique(size):
        own = np.flatnonzero(size == w)
        if w > 256:
            for i in own:
                out[i] = json.loads(ix.text(at[i]))
            continue
        rows = np.ascontiguousarray(ix.buf[ix.place[at[own]][:, None] + np.arange(w)]).view(f"V{w}").ravel()
        uniq, inv = np.unique(rows, return_inverse=True)
        texts = np.array([json.loads(u.tobytes().decode("utf-8", "replace")) for u in uniq] + [None], dtype=object)[:-1]
        out[own] = texts[inv]
    return out


def index_nodes(texts: Sequence[bytes], lone: frozenset[str] = frozenset(), embedded: frozenset[str] = frozenset(), prefixes: Sequence[str] | None = None):
    """All objects that are array elements: arrays ``doc, path, parent, array, elem, begin, end`` over ``texts``.

    Yields ``(index, columns)``; embedded strings come as a further pair whose ``doc`` points into the same ``texts``.
    """
    ix = Index(texts)
    yield from _nodes(ix, np.arange(len(texts)), lone, embedded, prefixes)


def _nodes(ix: Index, owner: np.ndarray, lone: frozenset[str], embedded: frozenset[str], prefixes):
    """Paths are joined level by level in Arrow: a token's path is its container's, taken once, and a key or a position."""
    opens = np.flatnonzero((ix.kind == _OPEN_O) | (ix.kind == _OPEN_A))
    if len(opens) == 0:
        return
    n = len(ix.kind)
    # the key of a value inside an object is the token two before it (key, colon, value)
    valued = np.zeros(n, dtype=bool)
    valued[opens] = True
    if embedded:
        valued |= (ix.kind == _STR) & ~ix.is_key
    idx = np.flatnonzero(valued)
    in_obj = (ix.container[idx] >= 0) & (ix.kind[ix.container[idx]] == _OPEN_O)
    keyed = idx[in_obj]
    keys = pa.array(_strings(ix, keyed - 2) if len(keyed) else [], pa.string())
    key_at = np.full(n, -1, dtype=np.int64)
    key_at[keyed] = np.arange(len(keyed))
    named = lambda names: keyed[pc.is_in(keys, pa.array(sorted(names), pa.string())).to_numpy(zero_copy_only=False)] if len(keyed) else keyed
    alone = np.zeros(n, dtype=bool)
    if lone:
        alone[named(lone)] = True
        alone &= ix.kind == _OPEN_O
    cand = np.zeros(n, dtype=bool)
    if embedded:
        cand[named(embedded)] = True
        cand &= ix.kind == _STR
    # the position of an element is the number of commas before it in its array
    comma = np.flatnonzero(ix.kind == _COMMA)
    box = ix.container[comma]
    order = np.lexsort((comma, box))
    comma, box = comma[order], box[order]
    elem = np.zeros(n, dtype=np.int64)
    in_arr = idx[(ix.container[idx] >= 0) & ~in_obj]
    c = ix.container[in_arr]
    span = np.int64(n + 1)
    elem[in_arr] = np.searchsorted(box * span + comma, c * span + in_arr) - np.searchsorted(box, c)
    places = pa.array([f"[{i}]" for i in range(int(elem.max()) + 1 if len(in_arr) else 0)], pa.string())

    emit = np.zeros(n, dtype=bool)
    emit[in_arr] = ix.kind[in_arr] == _OPEN_O
    emit |= alone
    slot = np.zeros(n, dtype=np.int64)  # where a token's texts lie among those of its level
    empty, none, dot = pa.scalar(""), pa.scalar(None, pa.string()), pa.scalar(".")
    got, embeds = [], []
    path = array = parent = None
    for d in np.unique(ix.level[idx]):
        own = idx[ix.level[idx] == d]
        up = ix.container[own]
        if up[0] < 0:  # tokens without a container are all there is on the first level
            if prefixes is None:
                path = array = pa.array([""] * len(own), pa.string())
                parent = pa.nulls(len(own), pa.string())
            else:
                pre = [prefixes[x] for x in ix.doc[own]]
                path, array = pa.array(pre, pa.string()), pa.array([re.sub(r"\[\d+\]", "", x) for x in pre], pa.string())
                parent = pa.array([_enclosing(x) for x in pre], pa.string())
        else:
            at = pa.array(slot[up])
            over, kinds = path.take(at), array.take(at)
            parent = pc.if_else(pa.array(emit[up]), over, parent.take(at))
            obj = ix.kind[up] == _OPEN_O
            is_obj = pa.array(obj)
            key = keys.take(pa.array(key_at[own], mask=~obj))
            tail = pc.coalesce(key, places.take(pa.array(elem[own], mask=obj))) if len(places) else key
            join = lambda x, y: pc.binary_join_element_wise(x, pc.if_else(pc.and_(is_obj, pc.not_equal(x, empty)), dot, empty), y, "")  # noqa: B023, E731
            path = join(over, tail)
            if alone[own].any():
                path = pc.binary_join_element_wise(path, pc.if_else(pa.array(alone[own]), pa.scalar("[0]"), empty), "")
            array = pc.if_else(is_obj, join(kinds, pc.coalesce(key, empty)), kinds)
        slot[own] = np.arange(len(own))
        keep = np.flatnonzero(emit[own])
        if len(keep):
            k = pa.array(keep)
            got.append((own[keep], path.take(k), parent.take(k), array.take(k)))
        if embedded and cand[own].any():
            k = np.flatnonzero(cand[own])
            embeds.append((own[k], path.take(pa.array(k)).to_pylist()))
    if got:
        node = np.concatenate([x[0] for x in got])
        order = np.argsort(node, kind="stable")
        node = node[order]
        text = [pa.concat_arrays([x[i] for x in got]).take(pa.array(order)) for i in (1, 2, 3)]
    else:
        node, text = np.empty(0, dtype=np.int64), [pa.array([], pa.string())] * 3
    closer = np.full(n, -1, dtype=np.int64)
    done = np.flatnonzero(ix.match >= 0)
    closer[ix.match[done]] = done
    yield ix, {
        "doc": owner[ix.doc[node]], "path": text[0], "parent": text[1], "array": text[2], "elem": elem[node],
        "begin": ix.place[node], "end": ix.place[closer[node]] + 1,
    }
    if embeds:
        held = np.concatenate([x[0] for x in embeds])
        order = np.argsort(held, kind="stable")
        under = [p for x in embeds for p in x[1]]
        inner = [s.encode("utf-8", "surrogatepass") for s in _strings(ix, held[order])]
        yield from _nodes(Index(inner), owner[ix.doc[held[order]]], lone, embedded, [under[i] for i in order])


def _enclosing(path: str) -> str | None:
    """The nearest node a path lies in: what stands up to its last element position."""
    cut = path.rfind("]")
    return path[: cut + 1] if cut >= 0 else None


def flatten_json(
    df: DataFrame, id_col: str, json_col: str, *, lone: Sequence[str] = (), embedded: Sequence[str] = (), body: bool = True
) -> DataFrame:
    """One row per object that is an element of an array, at any depth, of every whole JSON text of ``json_col``.

    Columns: the id, ``node_path`` (``plays[3].participants[0]``), ``parent_path`` (the nearest enclosing node or
    null), ``array_path`` (the path without positions: the name of the flat table the row belongs to), ``elem_no``
    and, with ``body``, ``node_json`` (the object's own text).  Rows of one ``array_path`` parsed with ``from_json``
    form one flat table; ``(id, parent_path)`` links it to its parent's ``(id, node_path)``.
    """
    lone_, embedded_ = frozenset(lone), frozenset(embedded)
    src = df.select(F.col(id_col).alias("id"), F.col(json_col).cast("binary").alias("js")).filter(F.col("js").isNotNull())
    fields = [
        T.StructField("id", src.schema["id"].dataType), T.StructField("node_path", T.StringType()), T.StructField("parent_path", T.StringType()),
        T.StructField("array_path", T.StringType()), T.StructField("elem_no", T.IntegerType()),
    ]
    if body:
        fields.append(T.StructField("node_json", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + texts.offset + 1)[texts.offset :])
            a = 0
            while a < len(texts):  # blocks of about 2 MB bound the memory of the index
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), 2 << 20)))
                yield from block(ids.slice(a, b - a), texts.slice(a, b - a).to_pylist())
                a = b

    def block(ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for ix, cols in index_nodes(texts, lone_, embedded_):
            if len(cols["doc"]) == 0:
                continue
            out = [ids.take(pa.array(cols["doc"])), cols["path"], cols["parent"], cols["array"], pa.array(cols["elem"].astype(np.int32))]
            if body:
                raw = ix.buf.tobytes()
                out.append(pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(cols["begin"].tolist(), cols["end"].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
