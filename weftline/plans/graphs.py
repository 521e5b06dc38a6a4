"""Graphs of documents, persons and places; entity resolution."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import times
from weftline.functions.text import fold_accents
from weftline.operators import entity as E
from weftline.operators import graph as G
from weftline.plans._util import r, rounded, t
from weftline.plans.textstats import FOLD_SQL as T_FOLD
from weftline.plans.textstats import endings_sql

T_ENDINGS = endings_sql()

_NAMES = "nm AS (SELECT DISTINCT row_no, trim(place) AS place, archive_key, name FROM (SELECT row_no, place, archive_key, unnest(person_names) AS name FROM papyri_documents) WHERE name IS NOT NULL AND trim(name) <> '')"


def _names(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "papyri_documents").select("row_no", F.trim("place").alias("place"), "archive_key", F.explode("person_names").alias("name"))
    return docs.filter("name is not null and trim(name) <> ''").distinct()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """All relations as undirected edges between 'd:', 'n:' and 'p:' vertices."""
    n = _names(spark, d)
    doc, name = F.concat(F.lit("d:"), "row_no"), F.concat(F.lit("n:"), "name")
    mentioned = n.select(doc.alias("src"), name.alias("dst"), F.lit("mentioned").alias("relation"), "row_no")
    co = G.pairs_within(n, "row_no", "name").select(F.concat(F.lit("n:"), "src").alias("src"), F.concat(F.lit("n:"), "dst").alias("dst"), F.lit("co-occurs").alias("relation"), "row_no")
    letters = t(spark, d, "papyri_documents").filter("sender is not null and recipient is not null and sender <> recipient")
    letter = letters.select(F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b"), "row_no")
    letter = letter.select(F.concat(F.lit("n:"), "a").alias("src"), F.concat(F.lit("n:"), "b").alias("dst"), F.lit("epistolary").alias("relation"), "row_no")
    located = n.filter("place is not null and place <> ''").select(doc.alias("src"), F.concat(F.lit("p:"), "place").alias("dst"), F.lit("located_in").alias("relation"), "row_no").distinct()
    return mentioned.unionByName(co).unionByName(letter).unionByName(located)


_EDGES = _NAMES + """, edges AS (
  SELECT 'd:' || row_no AS src, 'n:' || name AS dst, 'mentioned' AS relation, row_no FROM nm
  UNION ALL SELECT 'n:' || a.name, 'n:' || b.name, 'co-occurs', a.row_no FROM nm a JOIN nm b ON a.row_no = b.row_no AND a.name < b.name
  UNION ALL SELECT 'n:' || least(sender, recipient), 'n:' || greatest(sender, recipient), 'epistolary', row_no FROM papyri_documents WHERE sender IS NOT NULL AND recipient IS NOT NULL AND sender <> recipient
  UNION ALL SELECT DISTINCT 'd:' || row_no, 'p:' || place, 'located_in', row_no FROM nm WHERE place <> '')"""


@query("cooccurrence_edges", "GRA01", "JON20", sql=f"""
WITH {_EDGES} SELECT src, dst, count(*) AS weight, count(DISTINCT row_no) AS n_documents, min(row_no) AS first_document, max(row_no) AS last_document, array_to_string(list_sort(list_distinct(list(relation))), ',') AS relation_types
FROM edges GROUP BY ALL""")  # fmt: skip
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    m = G.merge_edges(_edges(spark, d).withColumnRenamed("row_no", "document"))
    return m.withColumn("relation_types", F.array_join("relation_types", ","))


@query("edge_documents", "AGG29", sql=f"WITH {_EDGES} SELECT DISTINCT src, dst, row_no AS document FROM edges")
def edge_documents(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_documents(_edges(spark, d).withColumnRenamed("row_no", "document"))


@query("graph_vertices", "GRA02", sql=f"""
WITH {_EDGES}, b AS (SELECT src AS id, row_no FROM edges UNION ALL SELECT dst, row_no FROM edges) SELECT id, left(id, 1) AS kind, min(row_no) AS first_document FROM b GROUP BY 1""")  # fmt: skip
def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return G.vertices(_edges(spark, d).withColumnRenamed("row_no", "document"))


@query("graph_counts", "GRA09", sql=f"""
WITH {_EDGES}, b AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT 'vertices ' || left(id, 1) AS what, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT src, dst FROM edges)""")  # fmt: skip
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of each kind, and edges."""
    e = _edges(spark, d).withColumnRenamed("row_no", "document")
    v = G.vertices(e).groupBy(F.concat(F.lit("vertices "), "kind").alias("what")).agg(F.count("*").alias("n"))
    return v.unionAll(e.select("src", "dst").distinct().agg(F.lit("edges").alias("what"), F.count("*").alias("n")))


@query("period_graph", "AGG23", sql="""
WITH k AS (SELECT row_no, floor((coalesce(date_range.year_from, date_range.year_to) + coalesce(date_range.year_to, date_range.year_from)) / 2) AS y,
  list_distinct(list_filter(person_names, lambda x: x IS NOT NULL AND trim(x) <> '')) AS l FROM papyri_documents),
p AS (SELECT *, CASE WHEN y IS NULL THEN 'Unknown' WHEN y <= -30 THEN 'Ptolemaic' WHEN y <= 284 THEN 'Early Roman' WHEN y <= 641 THEN 'Late Roman' ELSE 'Byzantine/Islamic' END AS period FROM k),
n AS (SELECT period, count(DISTINCT x) AS n_persons FROM (SELECT period, unnest(l) AS x FROM p) GROUP BY 1)
SELECT p.period, count(*) AS n_documents, coalesce(any_value(n_persons), 0) AS n_persons, coalesce(sum(len(l) * (len(l) - 1) // 2), 0)::BIGINT AS n_edges FROM p LEFT JOIN n USING (period) GROUP BY 1""")  # fmt: skip
def period_graph(spark: SparkSession, d: str) -> DataFrame:
    """Documents, distinct persons and pairs of persons of each period."""
    y = times.midpoint(F.col("date_range.year_from"), F.col("date_range.year_to"))
    names = F.array_distinct(F.filter("person_names", lambda x: x.isNotNull() & (F.trim(x) != "")))
    p = t(spark, d, "papyri_documents").select(F.coalesce(times.period(y), F.lit("Unknown")).alias("period"), names.alias("l")).withColumn("k", F.coalesce(F.size("l"), F.lit(0)))
    docs = p.groupBy("period").agg(F.count("*").alias("n_documents"), F.sum(F.when(F.col("k") > 1, F.floor(F.col("k") * (F.col("k") - 1) / 2)).otherwise(0)).alias("n_edges"))
    persons = p.select("period", F.explode("l").alias("x")).distinct().groupBy("period").agg(F.count("*").alias("n_persons"))
    return docs.join(persons, "period", "left").select("period", "n_documents", F.coalesce("n_persons", F.lit(0)).alias("n_persons"), "n_edges")


@query("degree", "GRA03", sql=f"""
WITH {_EDGES}, m AS (SELECT src, dst, count(*) AS w FROM edges GROUP BY ALL), b AS (SELECT src AS id, w FROM m UNION ALL SELECT dst, w FROM m)
SELECT id, count(*) AS degree, sum(w)::BIGINT AS weighted_degree FROM b GROUP BY 1""")  # fmt: skip
def degree(spark: SparkSession, d: str) -> DataFrame:
    m = _edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("w"))
    return G.degree(m, "w")


@query("strongest_edges", "GRA06", sql=f"WITH {_EDGES} SELECT src, dst, count(*) AS weight FROM edges GROUP BY ALL ORDER BY weight DESC, src, dst LIMIT 20")
def strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "src", "dst").limit(20)


@query("neighbours_by_kind", "GRA07", sql=f"""
WITH {_EDGES}, b AS (SELECT src AS id, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges) SELECT id, count(DISTINCT o) AS n FROM b WHERE starts_with(o, 'n:') GROUP BY 1""")  # fmt: skip
def neighbours_by_kind(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    v = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct().withColumn("kind", F.substring("id", 1, 1))
    return G.neighbours(e, v, "n")


@query("ego_archive", "GRA08", sql=f"""
WITH {_EDGES}, s AS (SELECT DISTINCT 'd:' || row_no AS id FROM papyri_documents WHERE substr(archive_key, 5)::BIGINT % 20 = 1)
SELECT DISTINCT src, dst, relation FROM edges WHERE src IN (SELECT id FROM s) OR dst IN (SELECT id FROM s)""")  # fmt: skip
def ego_archive(spark: SparkSession, d: str) -> DataFrame:
    seeds = t(spark, d, "papyri_documents").filter(F.substring("archive_key", 5, 20).cast("bigint") % 20 == 1).select(F.concat(F.lit("d:"), "row_no").alias("id")).distinct()
    return G.ego(_edges(spark, d).select("src", "dst", "relation").distinct(), seeds)


@query("components", "GRA04", sql=f"""
WITH RECURSIVE {_NAMES}, e AS (SELECT DISTINCT a.name AS x, b.name AS y FROM nm a JOIN nm b ON a.row_no = b.row_no AND a.name <> b.name),
w(id, r) AS (SELECT name, name FROM (SELECT DISTINCT x AS name FROM e) UNION SELECT e.y, w.r FROM w JOIN e ON e.x = w.id AND w.r < e.y)
SELECT id, min(r) AS component FROM w GROUP BY 1""")  # fmt: skip
def components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(G.pairs_within(_names(spark, d), "row_no", "name").select("src", "dst").distinct())


@query("place_network", "AGG27", "AGG28", "JON21", sql=f"""
WITH {_NAMES}, p AS (SELECT DISTINCT place, name FROM nm WHERE place <> '')
SELECT a.place AS src, b.place AS dst, count(*) AS weight FROM p a JOIN p b ON a.name = b.name AND a.place < b.place GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def place_network(spark: SparkSession, d: str) -> DataFrame:
    return G.shared_neighbours(_names(spark, d).filter("place <> ''"), "place", "name", 2)


@query("place_person_index", "AGG27", sql=f"""
WITH {_NAMES} SELECT place, count(DISTINCT name) AS n_persons, count(DISTINCT row_no) AS n_documents FROM nm WHERE place <> '' GROUP BY 1""")  # fmt: skip
def place_person_index(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).filter("place <> ''").groupBy("place").agg(F.countDistinct("name").alias("n_persons"), F.countDistinct("row_no").alias("n_documents"))


@query("insularity", "AGG30", sql=f"""
WITH {_NAMES}, k AS (SELECT name, bool_or(place LIKE '%kome%') AS h, bool_or(NOT place LIKE '%kome%') AS o FROM nm WHERE place <> '' GROUP BY 1)
SELECT CASE WHEN h AND o THEN 'both' WHEN h THEN 'home only' ELSE 'abroad only' END AS reach, count(*) AS n_members FROM k GROUP BY 1""")  # fmt: skip
def insularity(spark: SparkSession, d: str) -> DataFrame:
    return G.inside_outside(_names(spark, d).filter("place <> ''"), "name", "place", F.col("place").contains("kome"))


def _betweenness_sql(levels: int = 20) -> str:
    """All shortest ways counted level by level, for small graphs of a diameter below ``levels``."""
    out = """e AS MATERIALIZED (SELECT src AS a, dst AS b FROM net UNION ALL SELECT dst, src FROM net), n AS (SELECT count(DISTINCT a)::DOUBLE AS n FROM e),
  f0 AS MATERIALIZED (SELECT DISTINCT a AS s, a AS v, 0 AS d, 1.0::DOUBLE AS g FROM e), w0 AS MATERIALIZED (SELECT * FROM f0)"""
    for i in range(1, levels):
        out += f""", f{i} AS MATERIALIZED (SELECT f.s, e.b AS v, {i} AS d, sum(f.g) AS g FROM f{i - 1} f JOIN e ON e.a = f.v WHERE NOT EXISTS (SELECT 1 FROM w{i - 1} w WHERE w.s = f.s AND w.v = e.b) GROUP BY f.s, e.b),
  w{i} AS MATERIALIZED (SELECT * FROM w{i - 1} UNION ALL SELECT * FROM f{i})"""
    last = f"w{levels - 1}"
    return out + f""" SELECT k.a AS id, round(coalesce(any_value(c), 0) / ((any_value(n) - 1) * (any_value(n) - 2)), 6)::DOUBLE AS betweenness FROM (SELECT DISTINCT a FROM e) k CROSS JOIN n
  LEFT JOIN (SELECT x.v, sum(x.g * y.g / z.g) AS c FROM {last} x JOIN {last} y ON y.s = x.v AND x.s <> x.v AND y.v <> x.v JOIN {last} z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d GROUP BY 1) b ON b.v = k.a GROUP BY 1"""


@query("betweenness", "GRA05", sql=f"""
WITH {_NAMES}, p AS (SELECT DISTINCT place, name FROM nm WHERE place <> ''),
net AS MATERIALIZED (SELECT x.place AS src, y.place AS dst FROM p x JOIN p y ON x.name = y.name AND x.place < y.place GROUP BY ALL HAVING count(*) >= 2), {_betweenness_sql()}""")  # fmt: skip
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """The places of :func:`place_network`: how often each lies on the shortest ways between others, exactly."""
    k = _names(spark, d).filter("place <> ''").select("place", "name")
    ids = G.numbered(k, "place")
    return rounded(G.betweenness(G.shared_neighbours(k.join(ids, k["place"] == ids["id"]), "v", "name", 2), ids))


@query("supplier_components", "GRA04", "EXT14", sql="""
WITH RECURSIVE k AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), e AS (SELECT DISTINCT a.s AS x, b.s AS y FROM k a JOIN k b USING (o)),
c(id, least) AS (SELECT x, x FROM e UNION SELECT e.y, c.least FROM c JOIN e ON e.x = c.id WHERE c.least < e.y)
SELECT id, min(least) AS component FROM c GROUP BY 1""")  # fmt: skip
def supplier_components(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share orders, as components."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return G.components(G.pairs_within(li, "l_orderkey", "l_suppkey").select("src", "dst").distinct())


@query("name_pairs", "ENT01", "SET09", "FIL10", sql=f"""
WITH p AS (SELECT person_id, archive_key, lower({T_FOLD.format('canonical_name')}) AS f, coalesce(year_range.year_from, year_range.year_to) AS lo, coalesce(year_range.year_to, year_range.year_from) AS hi FROM canonical_persons),
w AS (SELECT DISTINCT person_id, i, regexp_replace(x, 'σ$', 'ς') AS w FROM (SELECT person_id, unnest(regexp_split_to_array(f, '[^\\p{{L}}]+')) AS x, generate_subscripts(regexp_split_to_array(f, '[^\\p{{L}}]+'), 1) AS i FROM p) WHERE length(x) > 1),
n AS (SELECT person_id, i, {T_ENDINGS} AS s FROM w), l AS (SELECT person_id, array_to_string(list(s ORDER BY i), ' ') AS whole, list_distinct(list(s)) AS s FROM n GROUP BY 1)
SELECT a.person_id AS a, b.person_id AS b FROM p a JOIN p b ON a.archive_key = b.archive_key AND a.person_id < b.person_id JOIN l x ON x.person_id = a.person_id JOIN l y ON y.person_id = b.person_id
WHERE len(list_intersect(x.s, y.s)) > 0 AND coalesce(a.lo - 200 <= b.hi AND b.lo - 200 <= a.hi, true)
  AND (a.f = b.f OR x.whole = y.whole AND length(x.whole) >= 4 OR len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.5)""")  # fmt: skip
def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of person rows of one archive that the rule takes for one person."""
    p = t(spark, d, "canonical_persons").select("person_id", "archive_key", "canonical_name", "year_range")
    pairs = E.candidate_pairs(p, "person_id", "canonical_name", "archive_key")
    side = lambda x: p.select(*[F.col(c).alias(f"{x}_{c}") for c in ("person_id", "canonical_name", "year_range")])
    j = pairs.join(side("a"), F.col("ka") == F.col("a_person_id")).join(side("b"), F.col("kb") == F.col("b_person_id"))
    lo = lambda x: F.coalesce(F.col(f"{x}_year_range.year_from"), F.col(f"{x}_year_range.year_to"))
    hi = lambda x: F.coalesce(F.col(f"{x}_year_range.year_to"), F.col(f"{x}_year_range.year_from"))
    return j.filter(E.same_person(F.col("a_canonical_name"), F.col("b_canonical_name"), lo("a"), hi("a"), lo("b"), hi("b"))).select(F.col("ka").alias("a"), F.col("kb").alias("b"))


@query("name_clusters", "ENT02", "ENT03")
def name_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of the person rows of each archive, merged to records."""
    p = t(spark, d, "canonical_persons").select("person_id", "archive_key", "canonical_name", "mention_count", "year_range.year_from", "year_range.year_to")
    s = p.withColumn("stems", E.stems(F.col("canonical_name"))).withColumn("n", F.coalesce("mention_count", F.lit(0)))
    c = E.greedy_clusters(s, "archive_key", "person_id", "stems", "n")
    return E.merge_records(p.join(c.select("person_id", "leader"), "person_id"), "leader", "canonical_name", "mention_count", "year_from", "year_to")


@query("name_cluster_rules", "ENT02", "ENT03", sql="""
SELECT count(*) AS person_rows, sum(coalesce(mention_count, 0))::BIGINT AS mentions, min(coalesce(year_range.year_from, year_range.year_from))::INTEGER AS year_from, max(year_range.year_to)::INTEGER AS year_to, true AS alike, true AS led, true AS apart FROM canonical_persons""")  # fmt: skip
def name_cluster_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of greedy clusters: no row, mention or year is lost; members share half of their leader's stems; leaders are
    their own members; and no leader of an archive could have joined another that comes before it."""
    p = t(spark, d, "canonical_persons").select("person_id", "archive_key", "canonical_name", "mention_count", "year_range.year_from", "year_range.year_to")
    s = p.withColumn("stems", E.stems(F.col("canonical_name"))).withColumn("n", F.coalesce("mention_count", F.lit(0)))
    c = E.greedy_clusters(s, "archive_key", "person_id", "stems", "n").select("person_id", "leader")
    led = s.join(c, "person_id").join(s.select(F.col("person_id").alias("leader"), F.col("stems").alias("ls")), "leader")
    near = lambda a, b: 2 * F.size(F.array_intersect(a, b)) >= F.size(F.array_union(a, b))
    rules = led.agg(F.count("*").alias("person_rows"), F.bool_and((F.col("leader") == F.col("person_id")) | near("stems", "ls")).alias("alike"), F.bool_or(F.col("leader") == F.col("person_id")).alias("led"))
    heads = led.filter("leader = person_id and archive_key is not null").select("archive_key", "person_id", "stems", F.explode(F.array_distinct("stems")).alias("stem"))
    other = heads.select("archive_key", F.col("person_id").alias("b"), F.col("stems").alias("bs"), "stem")
    clash = heads.join(other, ["archive_key", "stem"]).filter((F.col("person_id") < F.col("b")) & near("stems", "bs")).count()
    m = E.merge_records(led, "leader", "canonical_name", "mention_count", "year_from", "year_to").agg(F.sum("mention_count").alias("mentions"), F.min("year_from").alias("year_from"), F.max("year_to").alias("year_to"))
    return rules.join(m).select("person_rows", "mentions", "year_from", "year_to", "alike", "led", F.lit(clash == 0).alias("apart"))


@query("spelling_reduction", "ENT05", sql="""
SELECT round(100.0 * (1 - count(DISTINCT coalesce(archive_key, '') || '|' || coalesce(canonical_name, '')) / count(*)), 6)::DOUBLE AS reduction_pct FROM canonical_persons""")  # fmt: skip
def spelling_reduction(spark: SparkSession, d: str) -> DataFrame:
    """By how many per cent the distinct spellings of the archives are fewer than the person rows."""
    p = t(spark, d, "canonical_persons")
    return rounded(E.reduction(p, p.select(F.coalesce("archive_key", F.lit("")), F.coalesce("canonical_name", F.lit(""))).distinct()).select("reduction_pct"))


@query("name_reduction", "ENT05")
def name_reduction(spark: SparkSession, d: str) -> DataFrame:
    """By how many per cent the clusters are fewer than the person rows."""
    return rounded(E.reduction(t(spark, d, "canonical_persons"), name_clusters(spark, d)))


@query("cached_references", "ENT07", sql="""
WITH d AS (SELECT row_no, trim(tm_id) AS tm_id, cross_refs, batch_date FROM papyri_documents WHERE trim(tm_id) <> ''), k AS (SELECT *, (SELECT max(batch_date) FROM d) AS last FROM d WHERE cross_refs IS NOT NULL),
c AS (SELECT tm_id, arg_min(len(map_keys(cross_refs)), row_no) AS n FROM k WHERE batch_date < last GROUP BY 1), s AS (SELECT tm_id, arg_min(len(map_keys(cross_refs)), row_no) AS n FROM k WHERE batch_date IS NULL OR batch_date = last GROUP BY 1)
SELECT row_no, tm_id, coalesce(c.n, s.n)::INTEGER AS n_refs, c.n IS NOT NULL AS cached FROM d LEFT JOIN c USING (tm_id) LEFT JOIN s USING (tm_id)""")  # fmt: skip
def cached_references(spark: SparkSession, d: str) -> DataFrame:
    """References of every document with a TM number: the batches before the last are the cache, the last one is fetched from."""
    docs = t(spark, d, "papyri_documents").select("row_no", F.trim("tm_id").alias("tm_id"), "cross_refs", "batch_date").filter("tm_id <> ''")
    last = docs.agg(F.max("batch_date").alias("last"))
    known = docs.filter("cross_refs is not null").crossJoin(F.broadcast(last))
    refs = lambda k: k.groupBy("tm_id").agg(F.min_by("cross_refs", "row_no").alias("refs"))
    source = refs(known.filter("batch_date is null or batch_date = last"))
    got, _ = E.through_cache(docs.select("row_no", "tm_id"), "tm_id", refs(known.filter("batch_date < last")), "refs", lambda keys: source.join(keys, "tm_id", "left_semi"))
    return got.select("row_no", "tm_id", F.size(F.map_keys("refs")).alias("n_refs"), "cached")


@query("all_document_names", "ENT06", "SET06", sql="""
WITH k AS (SELECT row_no, list_concat(list_concat(coalesce(explicit_names, []), coalesce(person_names, [])), [sender, recipient]) AS l FROM papyri_documents)
SELECT row_no, x AS name FROM (SELECT row_no, unnest(list_distinct(list_filter(l, lambda x: x IS NOT NULL AND trim(x) <> ''))) AS x FROM k)""")  # fmt: skip
def all_document_names(spark: SparkSession, d: str) -> DataFrame:
    names = E.pipeline_names(F.col("person_names"), F.col("explicit_names"), F.col("sender"), F.col("recipient"))
    return t(spark, d, "papyri_documents").select("row_no", F.explode(names).alias("name"))


@query("variant_jaccard", "SET09", sql="""
WITH k AS (SELECT DISTINCT archive_key, w FROM (SELECT archive_key, unnest(string_split(lower(strip_accents(canonical_name)), ' ')) AS w FROM canonical_persons WHERE archive_key IS NOT NULL)),
s AS (SELECT archive_key, count(*) AS n FROM k GROUP BY 1), p AS (SELECT a.archive_key AS a, b.archive_key AS b, count(*) AS m FROM k a JOIN k b ON a.w = b.w AND a.archive_key <> b.archive_key AND substr(a.archive_key, 5)::BIGINT % 20 = 1 GROUP BY ALL)
SELECT a, b, round(m / (x.n + y.n - m), 6)::DOUBLE AS jac FROM p JOIN s x ON x.archive_key = a JOIN s y ON y.archive_key = b""")  # fmt: skip
def variant_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of names of every twentieth archive against every other's that shares a word with it."""
    k = t(spark, d, "canonical_persons").filter("archive_key is not null").select("archive_key", F.explode(F.split(F.lower(fold_accents(F.col("canonical_name"))), " ")).alias("w")).distinct()
    n = k.groupBy("archive_key").agg(F.count("*").alias("n"))
    q = k.filter(F.substring("archive_key", 5, 20).cast("bigint") % 20 == 1).withColumnRenamed("archive_key", "a")
    p = q.join(k.withColumnRenamed("archive_key", "b"), "w").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("m"))
    p = p.join(n.select(F.col("archive_key").alias("a"), F.col("n").alias("x")), "a").join(n.select(F.col("archive_key").alias("b"), F.col("n").alias("y")), "b")
    return p.select("a", "b", r(F.col("m") / (F.col("x") + F.col("y") - F.col("m"))).alias("jac"))
