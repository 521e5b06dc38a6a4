"""Variant spellings of names linked to the persons they mean.

A spelling is read as a given name and a father's name: remarks after a comma go, turned-round order is
told by the case endings (or a comma), and each part is reduced to a stem that the cases share.
Spellings of one block (an archive, say) become candidates by MinHash bands over padded q-grams of the
stems; a Monge-Elkan similarity over the parts, whose inner measure is the edit distance, verifies them;
verified links between rows of the person list are cut into stars, and every spelling takes the person
of its nearest verified spelling.

Only distinct spellings of a block are hashed and compared, so copies cost nothing; blocks never meet in
one task, since bands are joined by a key that mixes the block in.

Defined results
---------------
* null and blank spellings, and rows without a block, mean nobody;
* a spelling of a given name alone means the person of the block that lists just this spelling, else the only person
  of the block who bears that given name (by its stem); where several do, and where it is cut short, it means nobody;
* by-names of the list stand for the full name (in either direction); other given or father's names,
  however well the rest fits, are another person;
* a spelling as near to two persons goes to the one with more support, then the smaller id;
* copies of a row or spelling are linked alike; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.lsh import paired_band_keys, tune_paired_bands
from weftline.llm.unicode_form import bare
from weftline.session import cut_lineage

# Case endings of Greek names and of their Latin transcription, longest first, with the case they show.
ENDINGS = {
    "ωνοσ": "gen", "ωνι": "dat", "ωνα": "acc", "ων": "nom", "ουσ": "gen", "οσ": "nom", "ου": "gen", "ωι": "dat", "ον": "acc",
    "ασ": "nom", "αι": "dat", "αν": "acc", "ησ": "nom", "ηι": "dat", "ην": "acc", "α": "acc", "ω": "dat",
    "onos": "gen", "oni": "dat", "ona": "acc", "on": "nom", "os": "nom", "ou": "gen", "oi": "dat", "as": "nom", "ai": "dat",
    "an": "acc", "es": "nom", "us": "nom", "a": "acc", "o": "dat",
}
_BY_LENGTH = sorted(ENDINGS, key=len, reverse=True)
_FOLDS = [("ει", "ι"), ("ω", "ο"), ("η", "ι"), ("ei", "i"), ("ph", "f"), ("kh", "ch")]
# spellings that sound alike but that a slip of letters may also bring about: both readings are kept
_MAYBE = [("αι", "ε"), ("οι", "υ"), ("κσ", "ξ"), ("ai", "e"), ("oi", "y"), ("ks", "x")]
_LINKS = {"son", "of", "daughter", "the", "υιοσ", "υιου", "του", "τησ", "filius", "fil", "tou"}


fold_name = bare


@lru_cache(maxsize=100_000)
def read_part(word: str) -> tuple[str, str]:
    """(stem, case) of a folded name part; an abbreviation keeps its full stop and has the case 'cut'."""
    if word.endswith("."):
        return _respell(word[:-1]) + ".", "cut"
    for e in _BY_LENGTH:
        if word.endswith(e) and len(word) - len(e) >= 2:
            return _respell(word[: -len(e)]), ENDINGS[e]
    tail = word[-5:]
    for n in ("ων", "on"):
        k = tail.rfind(n)
        if k > 0 and len(word) - len(tail) + k >= 3:
            return _respell(word[: len(word) - len(tail) + k]), "odd"
    return _respell(word[:-2] if len(word) >= 6 else word), "odd"


def _respell(stem: str) -> str:
    for a, b in _FOLDS:
        stem = stem.replace(a, b)
    return stem


def _words(text: str) -> list[list[str]]:
    """The folded words of a spelling between its commas, without those that only link names."""
    parts = [re.findall(r"[^\W\d_]+\.?", p) for p in fold_name(text).split(",")]
    return [[w for w in p if w.strip(".") not in _LINKS] for p in parts]


def read_name(text: str | None) -> list[tuple[str, str]]:
    """The (given, father) readings of a spelling as stems: none, one, or more where order or endings can't be told."""
    if not text:
        return []
    parts = _words(text)
    turned = None
    if len(parts[0]) > 2:
        return _read_long(parts[0])
    if len(parts[0]) == 2:
        a, b = parts[0]
    elif len(parts[0]) == 1 and len(parts) > 1 and len(parts[1]) >= 1:
        a, b, turned = parts[1][0], parts[0][0], False
    else:
        return []
    if min(len(a.strip(".")), len(b.strip("."))) < 2:
        return []
    (_, ca), (_, cb) = read_part(a), read_part(b)
    if turned is False or ca in ("nom", "acc", "dat") or cb == "gen":
        orders = [(a, b)]
    elif ca == "gen" and cb in ("nom", "acc", "dat"):
        orders = [(b, a)]
    elif ca in ("odd", "cut") and cb == "nom":
        orders = [(b, a), (a, b)] if ca == "cut" else [(b, a)]
    elif ca == "gen" and cb in ("cut", "odd"):
        orders = [(a, b), (b, a)]
    else:
        orders = [(a, b)]
    return list(dict.fromkeys((g, f) for x, y in orders for g in _given_stems(x) for f in _father_stems(y)))


def _read_long(words: list[str]) -> list[tuple[str, str]]:
    """Readings of a name of more than two words: all of them count.  The father stands last, or first in the genitive
    before a nominative; the others together are the given name."""
    words = [w for w in words if len(w.strip(".")) >= 2]
    if len(words) < 2:
        return []
    cases = [read_part(w)[1] for w in words]
    turned = cases[0] == "gen" and cases[-1] in ("nom", "acc", "dat")
    father, given = (words[0], words[1:]) if turned else (words[-1], words[:-1])
    return list(dict.fromkeys((" ".join(read_part(w)[0].rstrip(".") for w in given), f) for f in _father_stems(father)))


def read_given(text: str | None) -> list[tuple[str, str]]:
    """The readings of a spelling that is a given name alone, without a father: its stems, and '=' with the folded word."""
    words = [w for p in _words(text) for w in p] if text else []
    if len(words) != 1 or words[0].endswith(".") or len(words[0]) < 2:
        return []
    return [("=" + words[0], ""), *((g, "") for g in _given_stems(words[0]))]


def _given_stems(word: str) -> list[str]:
    """Stems of a given name: what looks like the genitive of an n-stem may be a nominative in -onos."""
    stem = read_part(word)[0]
    if word.endswith(("ωνοσ", "ονοσ", "onos")) and len(word) >= 6:
        return _sounds([stem, _respell(word[:-2])])
    return _sounds([stem])


def _sounds(stems: list[str]) -> list[str]:
    out = list(stems)
    for s in stems:
        t = s
        for a, b in _MAYBE:
            t = t.replace(a, b)
        out.append(t)
    return list(dict.fromkeys(out))


def _father_stems(word: str) -> list[str]:
    """Stems of a father's name: it stands in the genitive, so any other ending is a slip, maybe of an n-stem."""
    stem, case = read_part(word)
    if case not in ("gen", "cut") and len(word) >= 7:
        return _sounds([stem, _respell(word[:-4])])
    return _sounds([stem])


def part_grams(stem: str) -> list[int]:
    """64-bit tokens of the padded bigrams of a stem; an abbreviation has no end."""
    s = "^" + (stem[:-1] if stem.endswith(".") else stem + "$")
    return list({(ord(x) << 21) | ord(y) for x, y in zip(s, s[1:])})


def spelling_nodes(df: DataFrame, block: str, spelling: str, keys: Sequence[str], by_names: dict[str, list[str]] | None = None) -> DataFrame:
    """``keys..., node, blk, given, father, by`` for each reading of each spelling; ``by`` marks a given name taken from
    the list of by-names.  ``node`` is a 64-bit hash of block, given and father's name; a given name alone has the father ''."""
    n = len(keys)
    src = df.select(*keys, F.col(block).alias("_b"), F.col(spelling).alias("_s")).filter(F.col("_b").isNotNull() & F.col("_s").rlike(r"\p{L}"))
    fields = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=200_000)(lambda s: read_name(s) or read_given(s))
        for b in batches:
            row, given, father, by = [], [], [], []
            for i, s in enumerate(b.column(n + 1).to_pylist()):
                for g, f in known(s):
                    for g2 in [g, *(by_names.get(g, ()) if by_names else ())]:
                        row.append(i)
                        given.append(g2)
                        father.append(f)
                        by.append(g2 is not g)
            at = pa.array(row, pa.int64())
            cols = [b.column(i).take(at) for i in range(n + 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(given, pa.string()), pa.array(father, pa.string()), pa.array(by, pa.bool_())], [*keys, "blk", "given", "father", "by"])

    out = src.mapInArrow(run, f"{fields}{', ' if n else ''}blk {src.schema['_b'].dataType.simpleString()}, given string, father string, by boolean")
    return out.withColumn("node", F.xxhash64("blk", "given", "father"))


def band_rows(nodes: DataFrame, bands: int) -> DataFrame:
    """``(key, node, lens)`` for every band of every distinct node; the key mixes the block in, ``lens`` holds the lengths of
    both parts (``given * 65536 + father``, 0 for an abbreviated part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(2).to_pylist() + b.column(3).to_pylist()
            slot: dict[str, int] = {}
            at = np.fromiter((slot.setdefault(w, len(slot)) for w in words), dtype=np.int64, count=len(words))
            sets = [part_grams(w) for w in slot]
            off = np.zeros(len(sets) + 1, dtype=np.int64)
            np.cumsum([len(s) for s in sets], out=off[1:])
            flat = np.fromiter((x for s in sets for x in s), dtype=np.uint64, count=int(off[-1]))
            salt = b.column(1).to_numpy().view(np.uint64)
            n = b.num_rows
            size = np.fromiter((0 if w.endswith(".") else min(len(w), 32_767) for w in slot), dtype=np.int64, count=len(slot))[at]
            keys = paired_band_keys(flat, off, at[:n], at[n:], bands, salt)
            lens = (size[:n] * 65_536 + size[n:]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), bands)), pa.array(np.repeat(lens, bands))], ["key", "node", "lens"])

    return nodes.select("node", F.xxhash64("blk").alias("s"), "given", "father").mapInArrow(run, "key bigint, node bigint, lens int")


def banded_pairs(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """Distinct ``(ln, rn)`` of nodes that share a band and whose parts differ in length by at most ``most`` letters (what
    more edits than that would be needed for can't be verified); abbreviations may have any length."""
    a = left.select("key", F.col("node").alias("ln"), F.col("lens").alias("la"))
    b = right.select("key", F.col("node").alias("rn"), F.col("lens").alias("lb"))

    def near(x: Column, y: Column) -> Column:
        return (x == 0) | (y == 0) | (F.abs(x - y) <= most)

    high, low = (lambda c: F.shiftright(c, 16)), (lambda c: F.col(c).bitwiseAND(65_535))
    pairs = a.join(b, "key").filter(near(high("la"), high("lb")) & near(low("la"), low("lb")))
    return pairs.select("ln", "rn").distinct()


def _part_distance(a: Column, b: Column) -> Column:
    """Edit distance of two stems; an abbreviated one is compared with the other's beginning."""
    ca, cb = a.endswith("."), b.endswith(".")
    sa, sb = F.rtrim(a, F.lit(".")), F.rtrim(b, F.lit("."))
    k = F.when(ca & cb, F.least(F.length(sa), F.length(sb))).when(ca, F.length(sa)).when(cb, F.length(sb)).otherwise(F.greatest(F.length(sa), F.length(sb)))
    return F.levenshtein(F.substring(sa, F.lit(1), k), F.substring(sb, F.lit(1), k))


def _fits(d: Column, a: Column, b: Column) -> Column:
    """Whether two parts that differ by ``d`` edits may be one: abbreviations must agree, short stems may differ by one edit
    or by letters out of order, longer ones by two edits."""
    n = F.least(F.length(a), F.length(b))
    letters = lambda c: F.array_sort(F.split(c, ""))
    abbreviated = a.endswith(".") | b.endswith(".")
    loose = (~abbreviated) & (d == 2) & ((n >= 6) | ((n >= 4) & (letters(a) == letters(b))))
    return (d == 0) | ((d == 1) & F.when(abbreviated, n >= 7).otherwise(n >= 3)) | loose


def verified_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """``(ln, rn, far, sim)`` of the candidate pairs that hold: total edit distance and Monge-Elkan similarity of the parts.

    With a given and a father's name in fixed roles, the best partner of each part is its counterpart, so the
    Monge-Elkan mean of best similarities is the mean over the two roles.
    """
    # the node's hash covers the block already; a second, short hash of it keeps blocks apart even where 64 bits collide
    a = left.select(F.col("node").alias("ln"), F.hash("blk").alias("lb"), F.col("given").alias("lg"), F.col("father").alias("lf"), F.col("by").alias("ly"))
    b = right.select(F.col("node").alias("rn"), F.hash("blk").alias("rb"), F.col("given").alias("rg"), F.col("father").alias("rf"), F.col("by").alias("ry"))
    dg, df_ = _part_distance(F.col("lg"), F.col("rg")), _part_distance(F.col("lf"), F.col("rf"))
    sim = lambda d, x, y: 1 - d / F.greatest(F.length(x), F.length(y))
    return (
        pairs.join(b, "rn")
        .join(a, "ln")
        .filter(F.col("lb") == F.col("rb"))
        .withColumn("dg", dg)
        .filter(F.when(F.col("ly") & F.col("ry"), F.lit(False)).when(F.col("ly") | F.col("ry"), F.col("dg") == 0).otherwise(_fits(F.col("dg"), F.col("lg"), F.col("rg"))))
        .withColumn("df", df_)
        .filter(_fits(F.col("df"), F.col("lf"), F.col("rf")) & (F.col("dg") + F.col("df") <= most))
        .select("ln", "rn", (F.col("dg") + F.col("df")).alias("far"), ((sim(F.col("dg"), F.col("lg"), F.col("rg")) + sim(F.col("df"), F.col("lf"), F.col("rf"))) / 2).alias("sim"))
    )


def star_clusters(rows: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(id, center)``: each round every row with the highest rank among its free neighbours becomes a centre, its free
    neighbours become its satellites (of the most similar centre).  ``rows(id, rank)``, ``edges(a, b, sim)`` once per pair.
    """
    both = edges.select("a", "b", "sim").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    degree = both.groupBy("a").agg(F.count("*").alias("deg")).withColumnRenamed("a", "id")
    ranked = rows.join(degree, "id").select("id", F.struct(F.col("deg"), F.col("rank"), (-F.col("id")).alias("low")).alias("rk"))
    live = cut_lineage(
        both.join(ranked.select(F.col("id").alias("a"), F.col("rk").alias("ra")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rk").alias("rb")), "b")
    )
    done = None
    for _ in range(max_rounds):
        centers = live.groupBy("a").agg(F.max("rb").alias("m"), F.first("ra").alias("ra")).filter(F.col("ra") > F.col("m")).select(F.col("a").alias("id"))
        sats = live.join(centers.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("sim", "rb")).alias("center"))
        new = cut_lineage(centers.select("id", F.col("id").alias("center")).unionAll(sats))
        done = new if done is None else done.unionAll(new)
        gone = new.select("id")
        live = cut_lineage(live.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
        if live.isEmpty():
            break
    else:
        raise RuntimeError("star clustering did not end")
    left = live.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("center"))
    return rows.select("id").join(done.unionAll(left), "id", "left").select("id", F.coalesce("center", "id").alias("center"))


def by_name_stems(nicknames: DataFrame, nick: str, full: str, max_rows: int = 100_000) -> dict[str, list[str]]:
    """Stem -> stems of the other names a bearer goes by.  The list is fixed and its size is checked."""
    got = nicknames.select(nick, full).limit(max_rows + 1).collect()
    if len(got) > max_rows:
        raise ValueError(f"more than {max_rows} by-names")
    out: dict[str, list[str]] = {}
    for a, b in got:
        if a and b:
            x, y = read_part(fold_name(a))[0], read_part(fold_name(b))[0]
            for p, q in ((x, y), (y, x)):
                if p != q and q not in out.setdefault(p, []):
                    out[p].append(q)
    return out


def given_alone(spellings: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., cluster)`` of the spellings ``(keys..., blk, given)`` without a father whose person can be told.

    ``known(blk, given, father, cluster)`` are the readings of the persons' spellings.  A spelling that one person lists
    letter for letter (a given with '=') goes before the bearers of its stems; more than one of either means nobody.
    """
    who = known.groupBy("blk", "given").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    listed = F.startswith("given", F.lit("="))
    got = spellings.join(who, ["blk", "given"]).groupBy(*keys).agg(
        *[f(F.when(c, F.col(k))).alias(n) for n, f, c, k in (("a", F.min, listed, "lo"), ("b", F.max, listed, "hi"), ("c", F.min, ~listed, "lo"), ("d", F.max, ~listed, "hi"))]
    )
    return got.select(*keys, F.coalesce(F.when(F.expr("a = b"), F.col("a")), F.when(F.expr("c = d"), F.col("c"))).alias("cluster")).filter("cluster is not null")


def link_spellings(
    persons: DataFrame, mentions: DataFrame, *, block: str, person: str, spellings: Sequence[str], support: str, mention_keys: Sequence[str], mention: str,
    by_names: dict[str, list[str]] | None = None, similarity: float = 0.3, recall: float = 0.97,
) -> tuple[DataFrame, DataFrame]:
    """(``person, cluster``) and (``mention_keys..., cluster, far, sim``).

    ``persons`` has one row per person row with ``spellings`` (text or array columns); ``mentions`` one row per
    occurrence.  ``cluster`` is the smallest person id of the person.  A band takes one MinHash of either part, so two
    spellings share it with the product of the q-gram similarities of their parts; the number of bands is read off the
    collision curve such that a product of ``similarity`` is met with ``recall``.  A person has several spellings, so
    misses are rarer still.
    """
    bands = tune_paired_bands(similarity, recall)
    persons = persons.filter(F.col(person).isNotNull())
    arrays = [F.col(s) if persons.schema[s].dataType.typeName() == "array" else F.array(s) for s in spellings]
    theirs = persons.select(F.col(person).alias("pid"), F.col(block).alias("blk_"), F.explode(F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))).alias("sp"))
    p_all = cut_lineage(spelling_nodes(theirs, "blk_", "sp", ["pid"], by_names).dropDuplicates(["pid", "node"]))
    p_occ = p_all.filter("father <> ''")
    p_nodes = cut_lineage(p_occ.groupBy("node").agg(F.first("blk").alias("blk"), F.first("given").alias("given"), F.first("father").alias("father"), F.min("by").alias("by")))
    m_all = cut_lineage(spelling_nodes(mentions, block, mention, list(mention_keys)).drop("by"))
    m_occ = m_all.filter("father <> ''")
    equal = p_nodes.select("node", F.lit(True).alias("equal"))
    m_nodes = cut_lineage(m_occ.select("node", "blk", "given", "father", F.lit(False).alias("by")).dropDuplicates(["node"]).join(equal, "node", "left"))
    p_bands = band_rows(p_nodes, bands)

    # rows with the same spellings are copies: the first stands for all of them
    alike = p_occ.groupBy("pid").agg(F.xxhash64(F.array_sort(F.collect_set("node")), F.count("*")).alias("sig"), F.min("blk").alias("blk"))
    copies = cut_lineage(alike.join(alike.groupBy("blk", "sig").agg(F.min("pid").alias("first")), ["blk", "sig"]).select("pid", "first"))

    # rows of the person list: verified links between their spellings, then stars
    near = verified_pairs(p_nodes, p_nodes, banded_pairs(p_bands, p_bands).filter("ln < rn"))
    own = p_occ.select("pid", "node")
    ones = own.join(copies.filter("pid = first").select("pid"), "pid", "left_semi")
    across = near.join(ones.select(F.col("node").alias("ln"), F.col("pid").alias("x")), "ln").join(ones.select(F.col("node").alias("rn"), F.col("pid").alias("y")), "rn").select("x", "y", "sim")
    first = ones.groupBy("node").agg(F.min("pid").alias("x"), F.count("*").alias("n")).filter("n > 1")  # rows that share a spelling hang on the first of them
    shared = ones.join(first, "node").select("x", F.col("pid").alias("y"), F.lit(1.0).alias("sim"))
    edges = across.unionAll(shared).filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("sim").alias("sim"))
    rank = persons.select(F.col(person).alias("pid"), F.coalesce(F.col(support), F.lit(0)).alias("rank"))
    head = rank.join(copies, "pid", "left").withColumn("id", F.coalesce("first", "pid"))
    stars = star_clusters(head.groupBy("id").agg(F.max("rank").alias("rank")), cut_lineage(edges))
    least = stars.groupBy("center").agg(F.min("id").alias("cluster"))
    clusters = cut_lineage(head.select("pid", "id").join(stars.join(least, "center").select("id", "cluster"), "id").select("pid", "cluster"))

    # rows with given names alone join the only person who bears the name; the smallest id of a person may then be theirs
    lone = p_all.groupBy("pid").agg(F.max("father").alias("f")).filter("f = ''").select("pid")
    alone = given_alone(p_all.join(lone, "pid", "left_semi").filter("not startswith(given, '=')").select("pid", "blk", "given"), p_occ.join(clusters, "pid"), ["pid"])
    joined = clusters.join(alone.withColumnRenamed("cluster", "to"), "pid", "left").select("pid", F.coalesce("to", "cluster").alias("c"))
    least = joined.groupBy("c").agg(F.min("pid").alias("cluster"))
    clusters = cut_lineage(joined.join(least, "c").select("pid", "cluster"))

    # occurrences: the nearest verified spelling of a person
    # one that equals a person's is nearer than any other can be; only the rest is banded
    exact = m_nodes.filter("equal").select(F.col("node").alias("ln"), F.col("node").alias("rn"), F.lit(0).alias("far"), F.lit(1.0).alias("sim"))
    rest = m_nodes.filter("equal is null")
    hits = verified_pairs(rest, p_nodes, banded_pairs(band_rows(rest, bands), p_bands)).unionByName(exact)
    who = own.join(clusters, "pid").groupBy("node", "cluster").agg(F.count("*").alias("n"))
    best = (
        hits.join(who.withColumnRenamed("node", "rn"), "rn")
        .groupBy("ln", "cluster")
        .agg(F.min("far").alias("far"), F.max("sim").alias("sim"), F.sum("n").alias("n"))
        .groupBy("ln")
        .agg(F.min(F.struct("far", (-F.col("sim")).alias("_s"), (-F.col("n")).alias("_n"), "cluster", "sim")).alias("b"))
    )
    found = (
        m_occ.select(*mention_keys, F.col("node").alias("ln"))
        .join(best, "ln")
        .groupBy(*mention_keys)
        .agg(F.min("b").alias("b"))
        .select(*mention_keys, "b.cluster", "b.far", "b.sim")
    )
    alone = given_alone(m_all.filter("father = ''").select(*mention_keys, "blk", "given"), p_all.join(clusters, "pid"), mention_keys)
    found = found.unionAll(alone.select(*mention_keys, "cluster", F.lit(0).alias("far"), F.lit(1.0).alias("sim")))
    return clusters.withColumnRenamed("pid", person), found
