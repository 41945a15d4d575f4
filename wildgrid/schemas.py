"""Fixed schemas of the raw inputs and of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

RANKS = ["kingdom", "phylum", "class", "order", "family", "genus"]


_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "tinyint": T.ByteType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(text: str) -> T.StructType:
    """Schema from ``name type, ...``; unlike DDL parsing it needs no session."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_RANKS_TEXT = ", ".join(f"{r} string" for r in RANKS)

# Raw dumps. Accuracy and date stay text: bad values there have their own rules.
RAW_OBSERVATIONS = _schema(
    "observation_uuid string, observer_id int, latitude double, longitude double, "
    "positional_accuracy string, taxon_id int, quality_grade string, observed_on string, anomaly_score float"
)
RAW_TAXA = _schema(
    "taxon_id int, ancestry string, rank_level float, rank string, name string, active boolean"
)
RAW_PHOTOS = _schema(
    "photo_id int, photo_uuid string, observation_uuid string, observer_id int, extension string, "
    "license string, width smallint, height smallint, position int"
)
RAW_OBSERVERS = _schema("observer_id int, login string")
CHECKLIST_TAXON = _schema(
    f"taxonID bigint, canonicalName string, scientificName string, {_RANKS_TEXT}, "
    "taxonRank string, taxonomicStatus string"
)
CHECKLIST_DISTRIBUTION = _schema(
    "taxonID bigint, countryCode string, occurrenceStatus string, threatStatus string"
)
CHECKLIST_VERNACULAR = _schema("taxonID bigint, vernacularName string, language string")
CHECKLIST_DESCRIPTION = _schema(
    "taxonID bigint, type string, description string, language string, source string, license string"
)
CHECKLIST_MULTIMEDIA = _schema("taxonID bigint, identifier string, license string, creator string")

# Stored tables.
OBSERVATIONS = _schema(
    "observation_uuid string, observer_id int, latitude double, longitude double, "
    "positional_accuracy int, taxon_id int, quality_grade string, year smallint, month tinyint, "
    "anomaly_score float, h3_r3 string, h3_r5 string"
)
TAXA = _schema(
    f"taxon_id int, rank_level float, rank string, name string, ancestry string, {_RANKS_TEXT}"
)
PHOTOS = _schema(
    "photo_id int, photo_uuid string, observation_uuid string, observer_id int, extension string, "
    "license string, width smallint, height smallint, photo_url string"
)
EXTERNAL_SPECIES = _schema(
    "taxon_id bigint, name string, family string, order string, image_url string, "
    "dataset_records bigint, subrepresented boolean, source_file string"
)
EMBEDDINGS = _schema("id_str string, embedding array<float>, description string")


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``: order, names and types; a missing column becomes NULL."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
