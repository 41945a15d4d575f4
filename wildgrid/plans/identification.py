"""Batch species identification by two-stage vector retrieval.

Inputs are vectors already encoded. Stage 1 compares each query with the text
vectors of every species in two spaces; stage 2 re-ranks the candidates with the
nearest reference image of each; stage 3 decides and states a confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wildgrid.functions import numeric, text
from wildgrid.operators import pruned
from wildgrid.operators.numbering import first_per_key
from wildgrid.operators.similarity import best_matches, best_similarity
from wildgrid.plans.external import augment_predictions
from wildgrid.session import shared_folder

TOP_M = 30
TOP_K = 10
WEIGHT = 0.7
SHOWN_STAGE1 = 10
INFO = ["name", "family", "order", "image_url", "dataset_records", "subrepresented"]


def align_spaces(text_clip: DataFrame, text_bio: DataFrame) -> DataFrame:
    """Text vectors present in both spaces: slug, description, clip, bio, copies.

    Equal rows are merged and counted. Of several vectors of one id in the
    second space the smallest is used.
    """
    second = text_bio.dropna(subset=["embedding"]).groupBy("id_str").agg(F.min("embedding").alias("bio"))
    first = text_clip.dropna(subset=["embedding"]).groupBy("id_str", "description", "embedding").agg(F.count("*").alias("copies"))
    return first.join(second, "id_str").select(
        F.col("id_str").alias("slug"), "description", F.col("embedding").alias("clip"), "bio", "copies"
    )


def species_by_slug(species: DataFrame) -> DataFrame:
    """Metadata with one row per slug, the first species kept."""
    named = species.filter("name is not null").select("taxon_id", *INFO)
    slugged = named.withColumn("slug", text.slug(F.col("name"))).withColumn("place", -F.col("taxon_id"))
    return first_per_key(slugged, ["slug"], ["place"]).drop("place", "taxon_id")


def stage1(
    queries: DataFrame, text_clip: DataFrame, text_bio: DataFrame, species: DataFrame, top_m: int = TOP_M,
    prune: bool = False,
) -> DataFrame:
    """Best ``top_m`` species texts per query, with species metadata.

    With ``prune`` blocks of texts that cannot hold any of them are not compared; the rows
    are the same. It runs at once, and pays where texts outnumber a few blocks.
    """
    encoded = queries.select("query_id", F.col("q_clip").alias("clip"), F.col("q_bio").alias("bio")).dropna()
    texts = align_spaces(text_clip, text_bio)
    found = pruned.best_matches(encoded, texts, top_m)[0] if prune else best_matches(encoded, texts, text_clip, top_m)
    order = [F.desc("score"), "slug", "description"]
    per_query = Window.partitionBy("query_id")
    best = found.withColumn("nth", F.row_number().over(per_query.orderBy(*order))).filter(F.col("nth") <= top_m)
    # A text listed several times takes as many ranks.
    listed = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top_m)))))
    ranked = listed.withColumn(
        "rank", F.row_number().over(per_query.orderBy("nth", "copy"))
    ).filter(F.col("rank") <= top_m)
    # A slug without metadata keeps NULL fields and a name made from the slug.
    joined = ranked.join(species_by_slug(species), "slug", "left")
    return joined.select(
        "query_id",
        "rank",
        "slug",
        F.coalesce("name", text.readable(F.col("slug"))).alias("name"),
        "family",
        "order",
        "image_url",
        "dataset_records",
        F.coalesce("subrepresented", F.lit(False)).alias("subrepresented"),
        "description",
        numeric.round_to(F.col("score_bio"), 4).alias("score_bioclip"),
        numeric.round_to(F.col("score_clip"), 4).alias("score_clip"),
        numeric.round_to(numeric.mean_of_two(F.col("score_clip"), F.col("score_bio")), 4).alias("score_ensemble"),
    )


def stage2(
    candidates: DataFrame, queries: DataFrame, anchors: DataFrame, weight: float = WEIGHT, top_k: int = TOP_K
) -> DataFrame:
    """Candidates re-ranked by text score and nearest anchor image; 0 without anchors.

    The rounded text score and the exact image score are blended; the rounded
    result is sorted, ties in stage-1 order.
    """
    encoded = queries.select("query_id", F.col("q_dino").alias("vector")).dropna()
    images = anchors.select(F.col("id_str").alias("slug"), F.col("embedding").alias("vector")).dropna()
    nearest = best_similarity(candidates, encoded, images, "slug")
    exact = F.coalesce("best", F.lit(0.0))
    final = numeric.round_to(numeric.blend(weight, F.col("score_ensemble"), exact), 4)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_final"), "rank"))
    return (
        candidates.join(nearest, ["query_id", "slug"], "left")
        .withColumn("score_dino", numeric.round_to(exact, 4))
        .withColumn("score_final", final)
        .drop("best")
        .withColumn("rank_final", place)
        .filter(F.col("rank_final") <= top_k)
        .withColumn("rank_delta", F.col("rank") - F.col("rank_final"))
    )


def _at_rank(column: str, rank: int) -> Column:
    return F.max(F.when(F.col("rank_final") == rank, F.col(f"`{column}`")))


def stage3(reranked: DataFrame, queries: DataFrame) -> DataFrame:
    """One decision per query; a query without candidates gets none and low confidence.

    At most ``top_k`` rows per query arrive here.
    """
    families = F.collect_list(F.struct("rank_final", "family", "order"))
    top = reranked.groupBy("query_id").agg(
        _at_rank("name", 1).alias("predicted_species"),
        _at_rank("family", 1).alias("family"),
        _at_rank("order", 1).alias("order"),
        _at_rank("score_final", 1).alias("first_score"),
        _at_rank("score_final", 2).alias("second_score"),
        F.bool_or((F.col("rank_final") == 1) & F.col("subrepresented")).alias("rare"),
        families.alias("members"),
        F.count("*").alias("n"),
    )

    def agreement(column: str) -> Column:
        votes = F.filter("members", lambda m: (m[column] != "") & (m[column] == F.col(f"`{column}`")))
        return F.size(votes) / F.col("n")

    margin = F.coalesce(F.col("first_score") - F.col("second_score"), F.col("first_score"))
    decided = (
        top.withColumn("exact_margin", margin)
        .withColumn("family_share", agreement("family"))
        .withColumn("order_share", agreement("order"))
    )
    decided = decided.select(
        "query_id",
        "predicted_species",
        "family",
        "order",
        numeric.confidence_tier(F.col("first_score"), F.col("exact_margin")).alias("confidence"),
        numeric.round_to(F.col("exact_margin"), 4).alias("margin"),
        numeric.round_to(F.col("family_share"), 2).alias("family_consensus"),
        numeric.round_to(F.col("order_share"), 2).alias("order_consensus"),
        _rationale().alias("rationale"),
    )
    none = numeric.confidence_tier(F.lit(0.0), F.lit(0.0))
    return (
        queries.select("query_id")
        .join(decided, "query_id", "left")
        .withColumn("confidence", F.coalesce("confidence", none))
        .withColumn("rationale", F.coalesce("rationale", F.lit(NO_CANDIDATES)))
    )


# Texts of the rationale.
NO_CANDIDATES = "Sin candidatos."
RATIONALE = (
    "Top-1 '%s' con score_final=%.4f; margen sobre #2 = %.4f; "
    "consenso de familia en top-%d = %d%%; consenso de orden = %d%%"
)
RARE_NOTE = "; especie subrepresentada en el dataset (pocos registros de referencia)"


def _rationale() -> Column:
    def whole_percent(share: str) -> Column:
        return numeric.round_to(F.col(share) * 100, 0).cast("int")

    told = F.format_string(
        RATIONALE,
        F.col("predicted_species"),
        F.col("first_score"),
        numeric.round_to(F.col("exact_margin"), 4),
        F.col("n"),
        whole_percent("family_share"),
        whole_percent("order_share"),
    )
    return F.concat(told, F.when(F.col("rare"), F.lit(RARE_NOTE)).otherwise(F.lit("")), F.lit("."))


def known_check(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """Whether the first prediction of each labelled query has the label's name."""
    labels = queries.filter("known_species <> ''").select("query_id", "known_species")
    first = predictions.filter("rank_final = 1").select("query_id", F.col("name").alias("top1_name"))
    same = F.lower("top1_name") == F.lower("known_species")
    return labels.join(first, "query_id").withColumn("top1_is_known", F.coalesce(same, F.lit(False)))


def identify(
    queries: DataFrame,
    text_clip: DataFrame,
    text_bio: DataFrame,
    anchors: DataFrame,
    species: DataFrame,
    top_m: int = TOP_M,
    top_k: int = TOP_K,
    weight: float = WEIGHT,
    only: str | None = None,
    prune: bool = False,
) -> dict[str, DataFrame]:
    """All stages: stage1 (the part shown), stage2, stage3, predictions, known.

    Stage 2 works on the whole of stage 1. The predictions are stage 2 with the
    metadata of the species list. The results of the two vector comparisons are
    checkpointed: they are short, several outputs read them, and a lost executor
    must not cause a second comparison. These checkpoints run when this is called;
    ``only="stage1"`` plans that stage alone and, without ``prune``, runs only the
    checkpoints of the two sides.
    """
    first = stage1(queries, text_clip, text_bio, species, top_m, prune)
    if only == "stage1":
        return {"stage1": first.filter(F.col("rank") <= SHOWN_STAGE1)}
    shared_folder(queries.sparkSession)
    first = first.checkpoint()
    second = stage2(first, queries, anchors, weight, top_k).checkpoint()
    predictions = augment_predictions(second, species)
    return {
        "stage1": first.filter(F.col("rank") <= SHOWN_STAGE1),
        "stage2": second,
        "stage3": stage3(second, queries),
        "predictions": predictions,
        "known": known_check(predictions, queries),
    }
