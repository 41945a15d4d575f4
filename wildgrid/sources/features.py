"""Polygon features: GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.sources.documents import CutDocuments

META = ["eco_id", "eco_name", "biome_num", "biome_name", "realm"]
# Attribute names of the source features, in the order of META.
SOURCE_META = ["ECO_ID", "ECO_NAME", "BIOME_NUM", "BIOME_NAME", "REALM"]

META_SCHEMA = "eco_id int, eco_name string, biome_num int, biome_name string, realm string"

_POLYGON = "array<array<array<double>>>"
_MULTI = f"array<{_POLYGON}>"
_GEOMETRY = "struct<type:string, coordinates:string>"


def _properties(names: list[str]) -> str:
    types = ["double", "string", "double", "string", "string"]
    return "struct<" + ", ".join(f"{n}:{t}" for n, t in zip(names, types)) + ">"


def parse_features(texts: DataFrame, text: str = "value", names: list[str] = SOURCE_META) -> DataFrame:
    """Features from GeoJSON texts, one feature each: META columns and ``parts``.

    ``parts`` has the multi-polygon nesting for both geometry types; it is empty
    for a missing or empty geometry.
    """
    schema = f"struct<properties:{_properties(names)}, geometry:{_GEOMETRY}>"
    parsed = texts.select(F.from_json(text, schema).alias("f")).select("f.properties.*", "f.geometry")
    # Ids may be written as reals.
    types = dict(part.split() for part in META_SCHEMA.split(", "))
    return parsed.select(
        *[F.col(n).cast(types[m]).alias(m) for n, m in zip(names, META)], _parts(F.col("geometry")).alias("parts")
    )


def _parts(geometry: Column) -> Column:
    one = F.array(F.from_json(geometry["coordinates"], _POLYGON))
    many = F.from_json(geometry["coordinates"], _MULTI)
    parts = F.when(geometry["type"] == "Polygon", one).when(geometry["type"] == "MultiPolygon", many)
    solid = F.filter(parts, lambda rings: F.coalesce(F.size(rings), F.lit(0)) > 0)
    return F.coalesce(solid, F.array().cast(_MULTI))


def _collected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source_file, position, value) of the features of collection files, and what is none."""
    cut = CutDocuments(spark, path)
    items = cut.items(["features"]).select("source_file", "position", F.col("record").alias("value"))
    # A text that is no object, or broken, has no members.
    type_of = F.from_json("value", "map<string, string>")["type"]
    is_feature = F.coalesce(type_of == "Feature", F.lit(False))
    listed = cut.members().filter("is_list and key = 'features'").select("source_file")
    without = cut.files.filter("valid").join(listed, "source_file", "left_anti").select(
        "source_file", F.lit(None).cast("long").alias("position"), F.lit("no list of features").alias("reason"))
    odd = items.filter(~is_feature).select("source_file", "position", F.lit("not a feature").alias("reason"))
    return items.filter(is_feature), cut.invalid().unionByName(without).unionByName(odd)


def read_features(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """GeoJSON features from files of one feature per line, or of one collection each.

    Files of both layouts are read by many tasks. A line that is not a feature, such as one of
    a collection, is an error; what is no feature in a collection is in ``rejected_features``.
    """
    if one_per_line:
        message = F.concat(F.lit("not one feature per line: "), F.left("value", F.lit(80)))
        is_feature = F.get_json_object("value", "$.type") == "Feature"
        lines = spark.read.text(path).filter(F.trim("value") != "")
        return parse_features(lines.select(F.when(is_feature, F.col("value")).otherwise(F.raise_error(message)).alias("value")))
    return parse_features(_collected(spark, path)[0].select("value"))


def rejected_features(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, position, reason) of collections, and of their parts, that give no features."""
    return _collected(spark, path)[1]


def valid_features(features: DataFrame) -> DataFrame:
    return features.filter(F.col("eco_id") > 0)


def with_shape(features: DataFrame) -> DataFrame:
    return features.filter(F.size("parts") > 0)


def region_meta(features: DataFrame) -> DataFrame:
    return valid_features(features).select(*META).orderBy("biome_num", "eco_name")


def region_counts(features: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: numbers of regions, biomes, realms and distinct cells."""
    n_cells = cells.agg(F.count_distinct("h3_r3")).scalar()
    return valid_features(features).agg(
        F.count("*").alias("n_regions"),
        F.count_distinct("biome_num").alias("n_biomes"),
        F.count_distinct("realm").alias("n_realms"),
    ).withColumn("n_cells", n_cells)


def as_geojson(features: DataFrame, name: str = "value") -> DataFrame:
    """One GeoJSON feature text per row, with every vertex."""
    geometry = F.when(
        F.size("parts") == 1,
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("parts")[0].alias("coordinates"))),
    ).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts").alias("coordinates"))))
    properties = F.to_json(F.struct(*META), {"ignoreNullFields": "false"})
    return features.select(
        F.format_string(
            '{"type":"Feature","properties":%s,"geometry":%s}',
            properties,
            F.when(F.size("parts") > 0, geometry).otherwise(F.lit("null")),
        ).alias(name)
    )


def write_features(features: DataFrame, path: str) -> None:
    """Valid features, one per line; one without a shape keeps a null geometry."""
    as_geojson(valid_features(features)).write.text(path)
