"""Queries of the training-text operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.llm.canonical import map_to_canonical
from weftline.llm.matching import match_names, match_teams
from weftline.llm.mixing import mix_report, mix_sources
from weftline.llm.persons import by_name_stems, link_spellings
from weftline.llm.name_tagger import fit_tagger
from weftline.llm.pii import detect_details, forename_set, mask_details, unmask_details
from weftline.llm.tokens import decode_corpus, encode_corpus
from weftline.llm.unicode_form import inconsistent_rows
from weftline.tables import load


# -- p4: free-typed places -> reference entries -------------------------------------------------------------------


def _typed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "papyri_documents").select(F.lit("papyri_documents").alias("table_name"), F.col("row_no").alias("row_key"), "place")
    runs = load(spark, sf_dir, "metadata_analysis_v2").select("run_no", F.posexplode("places.top_30_places").alias("pos", "p"))
    runs = runs.select(F.lit("metadata_analysis_v2").alias("table_name"), (F.col("run_no") * 100 + F.col("pos")).alias("row_key"), F.col("p.place").alias("place"))
    return docs.unionByName(runs)


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed_places(spark, sf_dir)
    mapped = map_to_canonical(typed, "place", load(spark, sf_dir, "place_reference"), "place_id", ["place_name", "alt_name"], "nome")
    return typed.join(mapped.select("place", "place_id"), "place").select("table_name", "row_key", "place_id")


@query("p4_unmatched")
def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct typed place that means no entry, with the rows that bear it."""
    typed = _typed_places(spark, sf_dir)
    mapped = map_to_canonical(typed, "place", load(spark, sf_dir, "place_reference"), "place_id", ["place_name", "alt_name"], "nome")
    return typed.groupBy("place").agg(F.count("*").alias("n_rows")).join(mapped.filter("place_id = -1").select("place"), "place")


# -- p6: visually identical text -----------------------------------------------------------------------------------


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda f, e, v: F.struct(F.lit(f).alias("field_name"), e.cast("int").alias("elem_no"), v.alias("value"))
    docs = load(spark, sf_dir, "papyri_documents").select(
        F.col("row_no").alias("row_key"),
        F.inline(
            F.concat(
                F.coalesce(F.transform("person_names", lambda v, i: value("papyri_documents.person_names", i, v)), F.array().cast("array<struct<field_name:string,elem_no:int,value:string>>")),
                F.array(value("papyri_documents.text", F.lit(-1), F.col("text"))),
            )
        ),
    )
    ours = load(spark, sf_dir, "trismegistos_matches_top50").select(
        F.col("match_id").alias("row_key"), F.lit("trismegistos_matches_top50.our_name").alias("field_name"), F.lit(-1).alias("elem_no"), F.col("our_name").alias("value")
    )
    return docs.unionByName(ours).filter(F.col("value").isNotNull())


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistent_rows(_readings(spark, sf_dir), "value").select("field_name", "row_key", "elem_no")


@query("p6_forms")
def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inconsistent value with its consistent form."""
    return inconsistent_rows(_readings(spark, sf_dir), "value", form=True)


# -- p8: token ids -------------------------------------------------------------------------------------------------


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("p8_texts")
def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return decode_corpus(encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "ids")


# -- p7: variant spellings of persons ------------------------------------------------------------------------------


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    persons = load(spark, sf_dir, "canonical_persons").select("person_id", "archive_key", "canonical_name", "variants", "mention_count")
    docs = load(spark, sf_dir, "papyri_documents").select("row_no", "archive_key", "person_names").filter(F.col("archive_key").isNotNull())
    mentions = docs.select("row_no", "archive_key", F.posexplode("person_names").alias("elem_no", "spelling"))
    return link_spellings(
        persons, mentions, block="archive_key", person="person_id", spellings=["canonical_name", "variants"], support="mention_count",
        mention_keys=["row_no", "elem_no"], mention="spelling", by_names=by_name_stems(load(spark, sf_dir, "name_nicknames"), "nickname", "full_name"),
    )


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, found = _links(spark, sf_dir)
    a = clusters.select(F.col("person_id").alias("left_key"), "cluster")
    pairs = a.join(clusters, "cluster").filter("left_key < person_id")
    rows = pairs.select(F.lit("person").alias("link_kind"), "left_key", F.lit(-1).alias("elem_no"), "person_id")
    return rows.unionAll(found.select(F.lit("mention").alias("link_kind"), F.col("row_no").alias("left_key"), F.col("elem_no").cast("int"), F.col("cluster").alias("person_id")))


@query("p7_spellings")
def p7_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked occurrence with the edit distance and similarity that verified it."""
    _, found = _links(spark, sf_dir)
    return found.select("row_no", "elem_no", F.col("cluster").alias("person_id"), F.col("far").alias("edits"), F.round("sim", 6).alias("similarity"))


# -- p5: entities without a common key -----------------------------------------------------------------------------


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = [F.col("first_year").alias("first"), F.col("last_year").alias("last"), F.col("name_type").alias("kind")]
    ours = load(spark, sf_dir, "trismegistos_matches_top50").select(F.col("match_id").alias("id"), F.col("our_name").alias("name"), *span)
    register = load(spark, sf_dir, "tm_names").select(F.col("tm_nam_id").alias("id"), F.col("tm_name").alias("name"), *span)
    teams = load(spark, sf_dir, "team_stats_2026").select(F.col("team_id").alias("id"), F.col("team_name").alias("name"), F.col("avg_pts").alias("points"), "games")
    listed = load(spark, sf_dir, "book_teams").select(
        F.col("book_team_id").alias("id"), F.col("listed_name").alias("name"), F.col("home_city").alias("town"), "nickname",
        F.col("points_pg").alias("points"), F.col("games_seen").alias("games"),
    )
    shape = lambda d, k: d.select(F.lit(k).alias("pair_kind"), F.col("lid").alias("our_key"), F.col("rid").alias("other_key"), "confidence")
    return shape(match_names(ours, register), "name").unionByName(shape(match_teams(teams, listed), "team"))


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("pair_kind", "our_key", "other_key")


@query("p5_confidence")
def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched pairs with the calibrated probability of each."""
    return _matches(spark, sf_dir)


# -- p9: mixing sources --------------------------------------------------------------------------------------------


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mix."""
    targets = load(spark, sf_dir, "mix_targets")
    return mix_report(mix_sources(load(spark, sf_dir, "documents"), targets), targets)


# -- p10: private details ------------------------------------------------------------------------------------------

#: the key of the pseudonyms; a deployment passes its own
DEMO_KEY = b"weftline demonstration key"


def _tagger(spark: SparkSession, sf_dir: str):
    return fit_tagger(load(spark, sf_dir, "documents"), "doc_id", "text", forename_set(load(spark, sf_dir, "given_names"), "given_name"))


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_details(load(spark, sf_dir, "documents"), "doc_id", "text", _tagger(spark, sf_dir))


@query("p10_masked")
def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its details replaced by typed, format-preserving pseudonyms."""
    return mask_details(load(spark, sf_dir, "documents"), "doc_id", "text", _tagger(spark, sf_dir), DEMO_KEY)


@query("p10_unmasked")
def p10_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked texts with their numbers and dates taken back by the key."""
    return unmask_details(p10_masked(spark, sf_dir), "doc_id", "text", DEMO_KEY)
