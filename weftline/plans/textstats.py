"""Text functions, n-grams and information theory."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import text as X
from weftline.functions import times
from weftline.operators import entity as E
from weftline.operators import sequences as Q
from weftline.operators import stats as I
from weftline.plans._util import r, rounded, t
from weftline.session import cut_lineage


def _tokens():
    """Words of any script with their marks, in small letters, both sigmas alike."""
    return F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ς"), F.lit("σ")), F.lit(r"(\p{L}[\p{L}\p{M}]*)"), F.lit(1))


_TOK = r"tok AS (SELECT doc_id, lang, regexp_extract_all(replace(lower(text), 'ς', 'σ'), '\p{L}[\p{L}\p{M}]*') AS l FROM documents WHERE text IS NOT NULL)"
_ROWS = _TOK + ", rows_ AS (SELECT doc_id, lang, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM tok)"
_PAIRS = _TOK + ", pairs AS (SELECT doc_id, lang, l[i] AS a, l[i + 1] AS b FROM (SELECT doc_id, lang, l, unnest(range(1, len(l))) AS i FROM tok WHERE len(l) > 1))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").filter("text is not null")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    g = Q.ngrams(_docs(spark, d), ["doc_id", "lang"], _tokens(), 2)
    return g.select("doc_id", "lang", F.get("gram", F.lit(0)).alias("a"), F.get("gram", F.lit(1)).alias("b"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "lang", F.explode(_tokens()).alias("token"))


@query("token_entropy", "INF01", "WIN14", sql=f"""
WITH {_ROWS}, c AS (SELECT lang, token, count(*) AS n FROM rows_ GROUP BY ALL), s AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1)
SELECT c.lang, any_value(total)::BIGINT AS total, round(-sum(n / total * log2(n / total)), 5) AS entropy FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang GROUP BY 1""")  # fmt: skip
def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.entropy(I.counts(_words(spark, d), ["lang"], "token"), ["lang"]), 5)


@query("char_entropy", "INF01", sql=r"""
WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(lower(text), 'ς', 'σ'), '\p{L}')) AS ch FROM documents) GROUP BY 1)
SELECT sum(n)::BIGINT AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c""")  # fmt: skip
def char_entropy(spark: SparkSession, d: str) -> DataFrame:
    ch = t(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ς"), F.lit("σ")), F.lit(r"(\p{L})"), F.lit(1))).alias("ch"))
    return rounded(I.entropy(I.counts(ch, [], "ch"), []))


@query("cond_entropy", "INF02", "INF03", sql=f"""
WITH {_PAIRS}, j AS (SELECT lang, a, b, count(*) AS n FROM pairs GROUP BY ALL), m AS (SELECT lang, a, sum(n) AS m, sum(n * log2(n)) AS s FROM j GROUP BY ALL)
SELECT lang, round(sum(m * log2(m) - s) / sum(m), 5) AS cond_entropy FROM m GROUP BY 1""")  # fmt: skip
def cond_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.conditional_entropy(_pairs(spark, d), ["lang"], "a", "b"), 5)


@query("cond_entropy_order2", "INF03", sql=f"""
WITH {_TOK}, g AS (SELECT lang, l[i] || ' ' || l[i + 1] AS a, l[i + 2] AS b FROM (SELECT lang, l, unnest(range(1, len(l) - 1)) AS i FROM tok WHERE len(l) > 2)),
j AS (SELECT lang, a, b, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT lang, a, sum(n) AS m, sum(n * log2(n)) AS s FROM j GROUP BY ALL)
SELECT lang, round(sum(m * log2(m) - s) / sum(m), 5) AS cond_entropy FROM m GROUP BY 1""")  # fmt: skip
def cond_entropy_order2(spark: SparkSession, d: str) -> DataFrame:
    g = Q.ngrams(_docs(spark, d), ["lang"], _tokens(), 3)
    p = g.select("lang", F.concat_ws(" ", F.get("gram", F.lit(0)), F.get("gram", F.lit(1))).alias("a"), F.get("gram", F.lit(2)).alias("b"))
    return rounded(I.conditional_entropy(p, ["lang"], "a", "b"), 5)


@query("sentence_entropy", "INF04", sql=f"""
WITH {_PAIRS}, j AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL), m AS (SELECT a, sum(n) AS m, sum(n * log2(n)) AS s FROM j GROUP BY 1)
SELECT round(avg(log2(m) - s / m), 6) AS mean_entropy, count(*) AS n_contexts FROM m""")  # fmt: skip
def sentence_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.mean_context_entropy(_pairs(spark, d), [], "a", "b"))


@query("zipf_fit", "INF05", "WIN16", "WIN17", sql=f"""
WITH {_ROWS}, c AS (SELECT token, count(*) AS n FROM rows_ GROUP BY 1), k AS (SELECT n, row_number() OVER (ORDER BY n DESC, token) AS rk FROM c)
SELECT count(*) AS types, round(regr_slope(ln(n), ln(rk)), 5) AS slope, round(regr_r2(ln(n), ln(rk)), 5) AS r2 FROM k WHERE rk <= 200""")  # fmt: skip
def zipf_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.zipf(I.counts(_words(spark, d), [], "token"), "token", top=200), 5)


@query("bigram_profile", "INF07", "WIN14", "WIN18", "JON25", sql=f"""
WITH {_PAIRS}, j AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL)
SELECT a, sum(n)::BIGINT AS total_out, count(*) AS n_successors, arg_min(b, (-n, b)) AS dominant, round(max(n) / sum(n), 6)::DOUBLE AS share,
  round(greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)), 5) AS entropy_out FROM j GROUP BY 1""")  # fmt: skip
def bigram_profile(spark: SparkSession, d: str) -> DataFrame:
    p = I.successors(_pairs(spark, d), "a", "b")
    return p.select("a", "total_out", "n_successors", "dominant", r("share").alias("share"), r("entropy_out", 5).alias("entropy_out"))


@query("bigram_predictability", "INF06", "INF11", "INF17", sql=f"""
WITH {_PAIRS}, j AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL), m AS (SELECT a, sum(n) AS m, max(n) / sum(n) AS s FROM j GROUP BY 1)
SELECT round(avg(CASE WHEN s > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS predictable, round(sum(CASE WHEN s > 0.5 THEN m ELSE 0 END) / sum(m), 6)::DOUBLE AS covered,
  CASE WHEN avg(CASE WHEN s > 0.5 THEN 1.0 ELSE 0.0 END) > 0.3 THEN 'formulaic' ELSE 'free' END AS verdict FROM m""")  # fmt: skip
def bigram_predictability(spark: SparkSession, d: str) -> DataFrame:
    p = I.successors(_pairs(spark, d), "a", "b")
    sure = F.when(F.col("share") > 0.5, 1.0).otherwise(0.0)
    return rounded(p.agg(F.avg(sure).alias("predictable"), (F.sum(sure * F.col("total_out")) / F.sum("total_out")).alias("covered"), F.when(F.avg(sure) > 0.3, "formulaic").otherwise("free").alias("verdict")))


@query("gini_share", "INF08", sql=f"""
WITH {_ROWS}, c AS (SELECT token, count(*) AS n FROM rows_ GROUP BY 1), k AS (SELECT n, row_number() OVER (ORDER BY n, token) AS i, count(*) OVER () AS m FROM c)
SELECT round(sum((2 * i - m - 1) * n) / (any_value(m) * sum(n)), 6)::DOUBLE AS gini FROM k""")  # fmt: skip
def gini_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.gini(I.counts(_words(spark, d), [], "token")))


@query("vocab_richness", "INF09", sql=f"""
WITH {_ROWS}, c AS (SELECT lang, token, count(*) AS n FROM rows_ GROUP BY ALL)
SELECT lang, count(*) AS types, sum(n)::BIGINT AS tokens, round(count(*) / sum(n), 6)::DOUBLE AS ttr, round(count_if(n = 1) / count(*), 6)::DOUBLE AS hapax_ratio FROM c GROUP BY 1""")  # fmt: skip
def vocab_richness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.richness(I.counts(_words(spark, d), ["lang"], "token"), ["lang"]))


@query("freq_quintiles", "AGG35", sql=f"""
WITH {_ROWS}, c AS (SELECT token, count(*) AS n FROM rows_ GROUP BY 1), k AS (SELECT n, row_number() OVER (ORDER BY n DESC, token) AS rk, count(*) OVER () AS m FROM c)
SELECT floor((rk - 1) / (m // 5))::BIGINT AS slice, count(*) AS types, round(avg(n), 6) AS mean_n FROM k WHERE (rk - 1) / (m // 5) < 5 GROUP BY 1""")  # fmt: skip
def freq_quintiles(spark: SparkSession, d: str) -> DataFrame:
    ranked = Q.global_rank(I.counts(_words(spark, d), [], "token"), [F.col("n").desc(), F.col("token").asc()])
    size = F.floor(ranked.select(F.count("*").alias("m")).first()["m"] / F.lit(5))
    k = ranked.withColumn("slice", F.floor((F.col("rank") - 1) / size)).filter("slice < 5")
    return rounded(k.groupBy("slice").agg(F.count("*").alias("types"), F.avg("n").alias("mean_n")))


_POS = "w AS (SELECT string_split(x, '') AS l FROM (SELECT unnest(l) AS x FROM tok) WHERE length(x) > 1)"


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words as letters ``l``, each with its number ``n``."""
    w = _words(spark, d).filter(F.length("token") > 1).groupBy("token").agg(F.count("*").alias("n"))
    return w.select(F.split("token", "").alias("l"), "n")


@query("positional_roles", "AGG34", "INF10", sql=f"""
WITH {_TOK}, {_POS}, p AS (SELECT l[i] AS token, i = 1 AS f, i = len(l) AS e FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM w)),
g AS (SELECT token, count(*) AS n, count_if(f) / count(*) AS a, count_if(NOT f AND NOT e) / count(*) AS b, count_if(e) / count(*) AS c FROM p GROUP BY 1 HAVING count(*) >= 5)
SELECT token, n, round(a, 6) AS share_first, round(b, 6) AS share_mid, round(c, 6) AS share_last,
  round((CASE WHEN a > 0 THEN -a * log2(a) ELSE 0 END) + (CASE WHEN b > 0 THEN -b * log2(b) ELSE 0 END) + (CASE WHEN c > 0 THEN -c * log2(c) ELSE 0 END), 6) AS entropy,
  CASE WHEN a >= 0.6 THEN 'initial' WHEN c >= 0.6 THEN 'final' WHEN b >= 0.6 THEN 'medial' ELSE 'free' END AS role FROM g""")  # fmt: skip
def positional_roles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.positions(_letters(spark, d), F.col("l"), 5, "n"))


def _kmeans_sql(rounds: int = 20) -> str:
    """The rounds of k-means, one after the other."""
    dist = " + ".join(f"(p.{x} - c.{x}) * (p.{x} - c.{x})" for x in "abc")
    out = "c0 AS (SELECT * FROM (VALUES (0, 0.8::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0.8, 0.1), (2, 0.1, 0.1, 0.8)) v(k, a, b, c))"
    for i in range(rounds + 1):
        out += f", m{i} AS MATERIALIZED (SELECT p.token, any_value(p.a) AS a, any_value(p.b) AS b, any_value(p.c) AS c, arg_min(c.k, ({dist}, c.k)) AS k FROM g p, c{i} c GROUP BY 1)"
        out += f", c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(avg(m.a), any_value(c{i}.a)) AS a, coalesce(avg(m.b), any_value(c{i}.b)) AS b, coalesce(avg(m.c), any_value(c{i}.c)) AS c FROM c{i} LEFT JOIN m{i} m USING (k) GROUP BY 1)"
    return out + f" SELECT token, k::INTEGER AS cluster FROM m{rounds}"


@query("kmeans_positions", "INF15", sql=f"""
WITH {_TOK}, {_POS}, p AS (SELECT l[i] AS token, i = 1 AS f, i = len(l) AS e FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM w)),
g AS MATERIALIZED (SELECT token, count_if(f) / count(*) AS a, count_if(NOT f AND NOT e) / count(*) AS b, count_if(e) / count(*) AS c FROM p GROUP BY 1 HAVING count(*) >= 5), {_kmeans_sql()}""")  # fmt: skip
def kmeans_positions(spark: SparkSession, d: str) -> DataFrame:
    """Letters clustered by where they stand in words, from fixed centres."""
    p = I.positions(_letters(spark, d), F.col("l"), 5, "n")
    return I.kmeans(p, "token", ["share_first", "share_mid", "share_last"], [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])


@query("dominant_chains", "INF16", "EXT14", sql=f"""
WITH RECURSIVE {_PAIRS}, j AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL),
l AS (SELECT a, arg_min(b, (-n, b)) AS b FROM j GROUP BY 1 HAVING max(n) / sum(n) >= 0.6 AND sum(n) >= 3),
c(start, path, tip) AS (SELECT a, [a, b], b FROM l WHERE a NOT IN (SELECT b FROM l) UNION ALL
  SELECT start, list_append(path, l.b), l.b FROM c JOIN l ON l.a = c.tip WHERE NOT list_contains(path, l.b))
SELECT start, arg_max(array_to_string(path, ' '), len(path)) AS path FROM c GROUP BY 1""")  # fmt: skip
def dominant_chains(spark: SparkSession, d: str) -> DataFrame:
    p = I.successors(_pairs(spark, d), "a", "b").filter("share >= 0.6 and total_out >= 3")
    c = I.chains(p.select("a", F.col("dominant").alias("b")))
    return c.select("start", F.array_join("path", " ").alias("path"))


@query("word_lengths", "AGG36", "INF14", sql=f"""
WITH {_ROWS}, c AS (SELECT length(token)::INTEGER AS len, count(*) AS n FROM rows_ GROUP BY 1) SELECT len, n, len = (SELECT arg_min(len, (-n, len)) FROM c) AS modal FROM c""")  # fmt: skip
def word_lengths(spark: SparkSession, d: str) -> DataFrame:
    c = _words(spark, d).groupBy(F.length("token").alias("len")).agg(F.count("*").alias("n"))
    m = c.agg(F.min_by("len", F.struct(-F.col("n"), F.col("len"))).alias("m"))
    return c.join(F.broadcast(m)).select("len", "n", (F.col("len") == F.col("m")).alias("modal"))


@query("convergence_orders", "INF18", "SIM04")
def convergence_orders(spark: SparkSession, d: str) -> DataFrame:
    """Conditional entropies of orders 1 to 5 of the real texts and of text made by a model of the same order, and their gap."""
    from weftline.operators.simulate import markov_text

    out = None
    for order in range(1, 6):
        real = _order(_docs(spark, d).select("text"), _tokens(), order)
        made = markov_text(real.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b", "n", [], 400, 40, 42, order=order)
        both = I.conditional_entropy(real, [], "a", "b").select(r("cond_entropy").alias("real")).join(I.conditional_entropy(_order(made, F.col("tokens"), order), [], "a", "b").select(r("cond_entropy").alias("made")))
        one = both.select(F.lit(order).alias("ord"), "real", "made", r(F.abs(F.col("real") - F.col("made"))).alias("gap"))
        out = one if out is None else out.unionByName(one)
    return out


def _order(src: DataFrame, tokens, order: int) -> DataFrame:
    """Contexts of ``order`` words and what follows."""
    g = Q.ngrams(src, [], tokens, order + 1)
    return g.select(F.array_join(F.slice("gram", 1, order), " ").alias("a"), F.element_at("gram", -1).alias("b"))


def _order_sql(k: int) -> str:
    return f"""SELECT {k} AS ord, round(sum(m * log2(m) - s) / sum(m), 5) AS h, sum(m)::BIGINT AS n_grams FROM (SELECT a, sum(n) AS m, sum(n * log2(n)) AS s FROM
  (SELECT array_to_string(l[i:i + {k - 1}], ' ') AS a, l[i + {k}] AS b, count(*) AS n FROM (SELECT l, unnest(range(1, len(l) - {k - 1})) AS i FROM tok WHERE len(l) > {k}) GROUP BY ALL) GROUP BY 1)"""


@query("entropy_orders", "WIN15", "WIN25", "INF03", sql=f"""
WITH {_TOK}, o AS ({' UNION ALL '.join(_order_sql(k) for k in range(1, 6))}),
p AS (SELECT *, abs(h - lag(h) OVER (ORDER BY ord)) AS move FROM o) SELECT ord, h, n_grams, coalesce(ord = (SELECT min(ord) FROM p WHERE move < 0.5), false) AS plateau FROM p""")  # fmt: skip
def entropy_orders(spark: SparkSession, d: str) -> DataFrame:
    """Windows of orders 1 to 5, their conditional entropies, and the first order at which these move by less than half a bit."""
    out = None
    for k in range(1, 6):
        p = _order(_docs(spark, d).select("text"), _tokens(), k)
        one = p.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
        one = one.agg(r(F.sum(F.col("m") * F.log2("m") - F.col("s")) / F.sum("m"), 5).alias("h"), F.sum("m").alias("n_grams")).select(F.lit(k).alias("ord"), "h", "n_grams")
        out = one if out is None else out.unionByName(one)
    out = cut_lineage(out)
    flat = Q.plateau(out, "ord", "h", 0.5).first()
    return out.withColumn("plateau", F.col("ord") == F.lit(flat[0] if flat and flat[0] is not None else -1))


# -- strings ---------------------------------------------------------------------------------------------------------------


@query("name_candidates", "STR07", "STR01", "FIL11", "ENT06", sql=r"""
WITH k AS (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}') AS l FROM documents)
SELECT doc_id, w AS name FROM (SELECT doc_id, unnest(list_distinct(l)) AS w FROM k) WHERE length(w) >= 3 AND w NOT IN ('The', 'This', 'Der', 'Die', 'Das', 'Eine', 'Une', 'Una')""")  # fmt: skip
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2})"), F.lit(1)), lambda x: F.length(x) >= 3))
    stop = spark.createDataFrame([(w,) for w in ("The", "This", "Der", "Die", "Das", "Eine", "Une", "Una")], "name string")
    return t(spark, d, "documents").select("doc_id", F.explode(found).alias("name")).join(F.broadcast(stop), "name", "left_anti").select("doc_id", "name")


@query("clean_texts", "STR01", "STR03", "STR18", sql=r"""
SELECT row_no, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS squeezed,
  coalesce(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(xml, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')), '') AS stripped,
  regexp_replace(split_part(split_part(source_url, '?', 1), '#', 1), '/+$', '') AS page FROM papyri_documents""")  # fmt: skip
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "papyri_documents").select("row_no", X.squeeze(F.coalesce("text", F.lit(""))).alias("squeezed"), X.strip_markup(F.col("xml")).alias("stripped"), X.page_address(F.col("source_url")).alias("page"))


@query("place_normalised", "STR09", "AGG24", sql=r"""
WITH k AS (SELECT row_no, trim(place) AS place FROM papyri_documents WHERE trim(place) <> ''),
a AS (SELECT row_no, place, trim(regexp_replace(place, '\s*\(\?\)\s*$', '')) AS once FROM k), b AS (SELECT row_no, place, trim(regexp_replace(once, '\s*\([^()]*\)\s*$', '')) AS twice FROM a)
SELECT CASE WHEN twice = '' THEN place ELSE twice END AS place, count(*) AS n FROM b GROUP BY 1""")  # fmt: skip
def place_normalised(spark: SparkSession, d: str) -> DataFrame:
    k = t(spark, d, "papyri_documents").select(F.trim("place").alias("place")).filter("place <> ''")
    return k.groupBy(X.drop_remark(F.col("place")).alias("place")).agg(F.count("*").alias("n"))


FOLD_SQL = rf"translate(regexp_replace({{}}, '\p{{{{Mn}}}}', '', 'g'), '{X.FOLD_FROM}', '{X.FOLD_TO}')"


@query("accent_fold", "STR04", sql=f"SELECT DISTINCT our_name, replace(lower({FOLD_SQL.format('our_name')}), 'ς', 'σ') AS folded FROM trismegistos_matches_top50 WHERE our_name IS NOT NULL")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    k = t(spark, d, "trismegistos_matches_top50").select("our_name").filter("our_name is not null").distinct()
    return k.select("our_name", F.replace(F.lower(X.fold_accents(F.col("our_name"))), F.lit("ς"), F.lit("σ")).alias("folded"))


def endings_sql() -> str:
    """The rule of the nominative as SQL: the first ending that leaves four letters decides."""
    fits = "WHEN suffix(w, '{o}') AND length(w) - {a} + {b} >= 4 THEN left(w, length(w) - {a}) || '{n}'"
    return "CASE " + " ".join(fits.format(o=o, n=n, a=len(o), b=len(n)) for n, olds in X.DECLENSIONS.items() for o in olds) + " ELSE w END"


@query("stem_suffix", "STR05", "STR06", sql=f"""
WITH k AS (SELECT DISTINCT regexp_replace(x, 'σ$', 'ς') AS w FROM (SELECT unnest(string_split(lower({FOLD_SQL.format('our_name')}), ' ')) AS x FROM trismegistos_matches_top50))
SELECT w, {endings_sql()} AS nominative FROM k WHERE length(w) > 1""")  # fmt: skip
def stem_suffix(spark: SparkSession, d: str) -> DataFrame:
    k = t(spark, d, "trismegistos_matches_top50").filter("our_name is not null")
    w = k.select(F.explode(F.split(F.lower(X.fold_accents(F.col("our_name"))), " ")).alias("x")).select(F.regexp_replace("x", "σ$", "ς").alias("w")).distinct()
    return w.filter(F.length("w") > 1).select("w", X.nominative(F.col("w")).alias("nominative"))


@query("mention_counts", "STR08", "AGG25", sql=r"""
SELECT source, count(*) AS n_docs, coalesce(sum(len(regexp_extract_all(lower(text), '\bthe\b'))), 0)::BIGINT AS n_mentions FROM documents GROUP BY 1""")  # fmt: skip
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(X.mentions(F.lower("text"), r"\bthe\b")).alias("n_mentions"))


@query("sentence_lengths", "STR13", sql=r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(list_sum(list_transform(l, lambda x: len(regexp_split_to_array(x, '[ \t\n\x0B\f\r]+')))) / len(l), 6) AS mean_words FROM s WHERE len(l) > 0""")  # fmt: skip
def sentence_lengths(spark: SparkSession, d: str) -> DataFrame:
    k = t(spark, d, "documents").filter("text is not null")
    return rounded(k.select("doc_id", X.sentence_length(F.col("text")).alias("mean_words")).filter("mean_words is not null"))


@query("string_forms", "STR15", "STR16", "STR22", sql=r"""
SELECT row_no, substr(captured_at::VARCHAR, 1, 13) AS hour_key, try_cast(nullif(regexp_extract(replace(date_text, ',', ''), '([-+]?[0-9]*\.?[0-9]+)', 1), '') AS DOUBLE) AS number,
  CASE WHEN regexp_matches(source_url, '^https?://(www\.)?(youtube\.com|youtu\.be)/') THEN 'video' WHEN regexp_matches(source_url, '\.(mp3|m4a|wav|ogg)$') THEN 'audio'
    WHEN regexp_matches(source_url, '(/feed|\.rss|\.xml)$') THEN 'feed' WHEN regexp_matches(source_url, '^https?://') THEN 'page' ELSE 'file' END AS kind,
  regexp_replace(source_url, '^[\s.,;:!?()\[\]{}"'']+|[\s.,;:!?()\[\]{}"'']+$', '', 'g') AS trimmed FROM papyri_documents""")  # fmt: skip
def string_forms(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "papyri_documents").select(
        "row_no", F.substring(F.col("captured_at").cast("string"), 1, 13).alias("hour_key"), X.decorated_number(F.col("date_text")).alias("number"),
        X.address_kind(F.col("source_url")).alias("kind"), X.trim_chars(F.col("source_url")).alias("trimmed"))


@query("fuzzy_best", "STR25", "SET09", sql="""
WITH a AS (SELECT DISTINCT place_name AS q FROM place_reference), p AS (SELECT a.q, b.q AS c, round(1 - levenshtein(lower(a.q), lower(b.q)) / greatest(length(a.q), length(b.q)), 9) AS s FROM a JOIN a b ON a.q <> b.q)
SELECT q, arg_min(c, (-s, c)) AS best, round(max(s), 6) AS score FROM p GROUP BY 1""")  # fmt: skip
def fuzzy_best(spark: SparkSession, d: str) -> DataFrame:
    """The most similar of all other names (ties: the first in order).  The choices are a fixed list, checked, that travels with the
    rows as a literal; each row looks through all of them in place, so nothing is joined or shuffled."""
    a = t(spark, d, "place_reference").select(F.col("place_name").alias("q")).filter("place_name is not null").distinct()
    return E.best_choice(a, "q", [x["q"] for x in a.orderBy("q").limit(E.MAX_CHOICES + 1).collect()]).select("q", "best", r("score").alias("score"))


# -- historical periods ------------------------------------------------------------------------------------------------------


@query("period_counts", "DT13", "DT14", "AGG22", sql="""
WITH k AS (SELECT floor((coalesce(date_range.year_from, date_range.year_to) + coalesce(date_range.year_to, date_range.year_from)) / 2) AS y, place FROM papyri_documents)
SELECT CASE WHEN y IS NULL THEN 'Unknown' WHEN y <= -30 THEN 'Ptolemaic' WHEN y <= 284 THEN 'Early Roman' WHEN y <= 641 THEN 'Late Roman' ELSE 'Byzantine/Islamic' END AS period,
  count(*) AS n, min(y)::INTEGER AS first_year, max(y)::INTEGER AS last_year, round(100.0 * count(place) / count(*), 6) AS pct_place FROM k GROUP BY 1""")  # fmt: skip
def period_counts(spark: SparkSession, d: str) -> DataFrame:
    y = times.midpoint(F.col("date_range.year_from"), F.col("date_range.year_to"))
    k = t(spark, d, "papyri_documents").select(y.alias("y"), "place")
    return k.groupBy(F.coalesce(times.period(F.col("y")), F.lit("Unknown")).alias("period")).agg(
        F.count("*").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year"), r(100.0 * F.count("place") / F.count("*")).alias("pct_place")
    )


@query("decade_rates", "AGG25", "DT12", "FIL12", sql=r"""
WITH k AS (SELECT (floor(floor((coalesce(date_range.year_from, date_range.year_to) + coalesce(date_range.year_to, date_range.year_from)) / 2) / 10) * 10)::INTEGER AS decade, len(regexp_extract_all(text, 'καὶ')) AS m FROM papyri_documents)
SELECT decade, count(*) AS n_docs, coalesce(sum(m), 0)::BIGINT AS mentions, round(coalesce(sum(m), 0) / count(*), 6)::DOUBLE AS rate FROM k WHERE decade BETWEEN -400 AND 1000 GROUP BY 1 HAVING count(*) >= 5""")  # fmt: skip
def decade_rates(spark: SparkSession, d: str) -> DataFrame:
    y = times.midpoint(F.col("date_range.year_from"), F.col("date_range.year_to"))
    k = t(spark, d, "papyri_documents").select(times.decade(y).alias("decade"), X.mentions(F.col("text"), "καὶ").alias("m")).filter(F.col("decade").between(-400, 1000))
    g = k.groupBy("decade").agg(F.count("*").alias("n_docs"), F.sum("m").alias("mentions")).filter("n_docs >= 5")
    return g.select("decade", "n_docs", "mentions", r(F.col("mentions") / F.col("n_docs")).alias("rate"))


@query("before_after_ratio", "AGG26", sql=r"""
WITH k AS (SELECT floor((coalesce(date_range.year_from, date_range.year_to) + coalesce(date_range.year_to, date_range.year_from)) / 2) AS y, len(regexp_extract_all(text, 'καὶ')) AS m FROM papyri_documents)
SELECT round(sum(CASE WHEN y < 212 THEN m END) / count_if(y < 212), 6)::DOUBLE AS before, round(sum(CASE WHEN y >= 212 THEN m END) / count_if(y >= 212), 6)::DOUBLE AS after_,
  round((sum(CASE WHEN y >= 212 THEN m END) / count_if(y >= 212)) / nullif(sum(CASE WHEN y < 212 THEN m END) / count_if(y < 212), 0), 6)::DOUBLE AS ratio FROM k""")  # fmt: skip
def before_after_ratio(spark: SparkSession, d: str) -> DataFrame:
    y = times.midpoint(F.col("date_range.year_from"), F.col("date_range.year_to"))
    k = t(spark, d, "papyri_documents").select(y.alias("y"), F.regexp_count("text", F.lit("καὶ")).alias("m"))
    rate = lambda c: F.sum(F.when(c, F.col("m"))) / F.nullif(F.count_if(c), F.lit(0))
    b, a = rate(F.col("y") < 212), rate(F.col("y") >= 212)
    return rounded(k.agg(b.alias("before"), a.alias("after_"), (a / F.nullif(b, F.lit(0.0))).alias("ratio")))


@query("parsed_dates", "DT10", "DT01", sql="""
SELECT fetch_no, fetched_at::DATE AS day, date_trunc('hour', fetched_at)::TIMESTAMP AS hour FROM season_pbp_2026""")  # fmt: skip
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    txt = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss")
    return t(spark, d, "season_pbp_2026").select("fetch_no", times.tolerant_date(txt).alias("day"), times.hour_key(txt).cast("timestamp_ntz").alias("hour"))
