"""External species lists: JSON documents of three shapes into one row shape.

Documents come as texts, one a row (``extract_records``), or as files, which are cut into their
records by many tasks (``read_records``). Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.sources import structure

# Keys under which a document may hold a list of records.
LIST_KEYS = ["preview", "data", "results", "items"]
# A text field may be as long as a value can be at all.
LONG_TEXTS = {"maxStringLen": "2147483647"}


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, text) of every .json file below ``root``, one document each."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    )


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _text(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", "string")


def _filled(value: Column, field: str) -> Column:
    """The field as text; an empty string, 0 and false count as absent."""
    raw = F.try_variant_get(value, f"$.{field}", "variant")
    text = _text(value, field)
    number = F.when(~_kind(raw).isin("STRING", "BOOLEAN"), text.try_cast("double"))
    empty = (text == "") | (number == 0) | ((_kind(raw) == "BOOLEAN") & (text == "false"))
    return F.when(~F.coalesce(empty, F.lit(False)), text)


def _shape(text: Column) -> Column:
    """OBJECT or ARRAY by the first character of a document, else NULL."""
    first = F.left(F.regexp_replace(text, r"^[\s\x{FEFF}]+", ""), F.lit(1))
    return F.when(first == "{", "OBJECT").when(first == "[", "ARRAY")


def last_of_key(entries: Column) -> Column:
    """(at, key, value) of the entries whose key does not come again, in order."""
    placed = F.transform(entries, lambda e, i: F.struct(i.alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    # Sorted by key and place, an entry is the last of its key if its neighbour has another one.
    by_key = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value"))))
    beside = F.arrays_zip(by_key.alias("one"), F.slice(by_key, F.lit(2), F.greatest(F.size(by_key), F.lit(1))).alias("next"))
    last = F.filter(beside, lambda p: ~F.equal_null(p["one"]["key"], p["next"]["key"]))
    sorted_back = F.array_sort(F.transform(last, lambda p: F.struct(
        p["one"]["at"].alias("at"), p["one"]["key"].alias("key"), p["one"]["value"].alias("value"))))
    keys = F.transform(entries, lambda e: e["key"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), placed).otherwise(sorted_back)


def members_of(text: Column) -> Column:
    """(at, key, value) of the members of an object, the last of each key; NULL if it can't be read."""
    return last_of_key(F.map_entries(F.from_json(text, "map<string, string>", LONG_TEXTS)))


def lenient_variant(text: Column) -> Column:
    """A value as a variant; an object with repeated keys or NaN is read member by member."""
    pairs = F.transform(members_of(text), lambda e: F.struct(e["key"], e["value"]))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.to_json(F.map_from_entries(pairs))))


def _entries(documents: DataFrame) -> DataFrame:
    """Documents with ``is_map`` and ``entries``, the texts of their records; NULL if unreadable.

    The texts are cut out by the parser of streams, which has no limit for a document, and
    each record is read on its own: an odd record costs no other.
    """
    entry = "array<struct<position:int, key:string, record:string>>"

    def listed(text: Column) -> Column:
        return F.from_json(text, "array<string>", LONG_TEXTS)

    shaped = documents.withColumn("shape", _shape(F.col("text"))).withColumn(
        "members", F.when(F.col("shape") == "OBJECT", members_of(F.col("text")))
    )
    all_objects = F.forall("members", lambda e: F.coalesce(F.startswith(e["value"], F.lit("{")), F.lit(False)))

    def member(key: str) -> Column:
        return F.get(F.filter("members", lambda e: e["key"] == key), F.lit(0))["value"]

    keyed = F.concat(*[F.coalesce(listed(member(k)), F.array().cast("array<string>")) for k in LIST_KEYS])
    mapped = F.transform("members", lambda e: F.struct(e["at"].alias("position"), e["key"].alias("key"), e["value"].alias("record")))

    def numbered(values: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.transform(values, lambda v, i: F.struct(i.alias("position"), none.alias("key"), v.alias("record"))).cast(entry)

    return (
        shaped.withColumn("is_map", (F.col("shape") == "OBJECT") & F.coalesce(all_objects, F.lit(False)))
        .withColumn(
            "entries",
            F.when(F.col("members").isNotNull(), F.when(F.col("is_map"), mapped.cast(entry)).otherwise(numbered(keyed)))
            .when(F.col("shape") == "ARRAY", numbered(listed(F.col("text")))),
        )
        .drop("members")
    )


def _is_object() -> Column:
    return F.coalesce(_kind(F.col("record")), F.lit("VOID")) == "OBJECT"


def extract_records(documents: DataFrame) -> DataFrame:
    """One row per record; what cannot be read is in ``rejected_documents``.

    A document may map names to records, hold lists of records under LIST_KEYS,
    or be a list. An object is a map of records only if all its values are
    objects. Of a repeated key the last value counts. ``position`` follows the order
    inside the document and counts all entries, also those that are no records.
    """
    # An inner explode makes Spark test the size of ``entries`` first, which cuts every text twice.
    records = (
        _entries(documents)
        .select("source_file", "is_map", F.explode_outer("entries").alias("e"))
        .filter("e is not null")
        .select("source_file", "is_map", "e.position", "e.key", lenient_variant(F.col("e.record")).alias("record"))
    )
    return _fields(records.filter(_is_object()))


def rejected_documents(documents: DataFrame) -> DataFrame:
    """(source_file, position, reason) of documents and records that give no rows.

    ``position`` is NULL for a whole document.
    """
    cut = _entries(documents)
    whole = cut.filter("entries is null").select("source_file", F.lit(None).cast("long").alias("position"), _why_rejected())
    parts = cut.select("source_file", F.explode("entries").alias("e")).withColumn("record", lenient_variant(F.col("e.record")))
    return whole.unionByName(
        parts.filter(~_is_object()).select("source_file", F.col("e.position").cast("long").alias("position"), F.lit("not an object").alias("reason"))
    )


def _why_rejected() -> Column:
    return F.when(F.col("shape").isNull(), "neither object nor list").otherwise("not valid JSON").alias("reason")


class CutDocuments:
    """JSON files cut into entries by many tasks; reads the files when it is made.

    ``files`` has (source_file, shape, valid), ``units`` the members of each file's outermost
    container and the items of its lists, in the order ``nth``.
    """

    def __init__(self, spark: SparkSession, path: str, **options):
        units, files = structure.cut_documents(spark, path, **options)
        empty = spark.read.options(**options).format("binaryFile").load(path).filter("length = 0").select(
            F.col("_metadata.file_path").alias("source_file"), F.lit(None).cast("string").alias("shape"), F.lit(False).alias("valid"))
        self.files = files.unionByName(empty)
        written = F.trim(F.regexp_replace(F.left("unit", F.lit(64)), r"\s+", "")) != ""
        units = units.join(files.filter("valid").select("source_file", "shape"), "source_file")
        # An empty container has one blank member.
        units = units.filter(written | (F.col("nth") > 0) | (F.col("ends") != structure.DOC_END))
        # A list that ends in a blank is empty, or ends in a comma, which is let pass.
        self.units = units.withColumn("blank", ~written & (F.col("begins") == "item") & (F.col("ends") == structure.LIST_END))

    def elements(self) -> DataFrame:
        """(source_file, position, record) of the documents that are lists."""
        return self.units.filter("shape = 'ARRAY'").select("source_file", F.col("nth").alias("position"), F.col("unit").alias("record"))

    def members(self) -> DataFrame:
        """(source_file, nth, key, value, is_list) of the objects, the last of each key.

        The items of a list are not in its value. A member that can't be read has a NULL key.
        """
        is_list = F.col("ends") == structure.LIST
        text = F.concat(F.lit("{"), "unit", F.when(is_list, F.lit("[]}")).otherwise(F.lit("}")))
        entry = F.get(F.map_entries(F.from_json(text, "map<string, string>", LONG_TEXTS)), F.lit(0))
        found = self.units.filter("shape = 'OBJECT' and begins = 'member'").select(
            "source_file", "nth", entry["key"].alias("key"), entry["value"].alias("value"), is_list.alias("is_list"))
        again = found.filter("key is not null").groupBy("source_file", "key").agg(F.count(F.lit(1)).alias("n"), F.max("nth").alias("last"))
        again = again.filter("n > 1").select("source_file", "key", "last")
        return found.join(again, ["source_file", "key"], "left").filter("last is null or last = nth").drop("last").select(*found.columns)

    def items(self, keys: list[str]) -> DataFrame:
        """(source_file, key, position, record) of the lists under ``keys``, in the order of the keys."""
        heads = self.members().filter("is_list").filter(F.col("key").isin(keys)).select("source_file", "key", "nth")
        ends = self.units.filter((F.col("begins") == "item") & (F.col("ends") == structure.LIST_END))
        # A list's items are those up to the next that ends a list. A row per list.
        ends = ends.select("source_file", F.lit(None).cast("string").alias("key"), "nth", (F.col("nth") - F.col("blank").cast("int")).alias("stop"))
        lists = heads.withColumn("stop", F.lit(None).cast("long")).unionByName(ends)
        following = Window.partitionBy("source_file").orderBy("nth").rowsBetween(1, Window.unboundedFollowing)
        end = F.min("stop").over(following)
        lists = lists.withColumn("end", end).filter("key is not null")
        order = F.array_position(F.lit(keys), F.col("key"))
        before = Window.partitionBy("source_file").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        base = F.coalesce(F.sum(F.col("end") - F.col("nth")).over(before), F.lit(0))
        lists = lists.select(F.col("source_file").alias("of"), "key", F.col("nth").alias("head"), "end", base.alias("base"))
        items = self.units.filter("shape = 'OBJECT' and begins = 'item' and not blank")
        return items.join(lists, (F.col("source_file") == F.col("of")) & F.col("nth").between(F.col("head") + 1, F.col("end"))).select(
            "source_file", "key", (F.col("base") + F.col("nth") - F.col("head") - 1).alias("position"), F.col("unit").alias("record"))

    def invalid(self) -> DataFrame:
        none = F.lit(None).cast("long").alias("position")
        return self.files.filter("not valid").select("source_file", none, _why_rejected())


def _file_records(cut: CutDocuments) -> DataFrame:
    """(source_file, is_map, position, key, record) of the entries of cut files."""
    members = cut.members()
    is_object = ~F.col("is_list") & F.coalesce(F.startswith("value", F.lit("{")), F.lit(False))
    maps = members.groupBy("source_file").agg(F.bool_and(is_object).alias("is_map")).filter("is_map").select("source_file")
    none = F.lit(None).cast("string").alias("key")
    mapped = members.join(maps, "source_file", "left_semi").select(
        "source_file", F.lit(True).alias("is_map"), F.col("nth").alias("position"), "key", F.col("value").alias("record"))
    listed = cut.elements().unionByName(
        cut.items(LIST_KEYS).join(maps, "source_file", "left_anti").select("source_file", "position", "record"))
    return mapped.unionByName(listed.select("source_file", F.lit(False).alias("is_map"), "position", none, "record")).withColumn(
        "record", lenient_variant(F.col("record")))


def read_records(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Records of all .json files below ``root``, and (source_file, position, reason) of what gives none.

    The rows are those of ``extract_records``; files of any size are read by many tasks. A
    member that can't be read costs no other.
    """
    cut = CutDocuments(spark, root, recursiveFileLookup=True, pathGlobFilter="*.json")
    records = _file_records(cut)
    unread = cut.members().filter("key is null").select("source_file", F.col("nth").alias("position"), F.lit("not valid JSON").alias("reason"))
    odd = records.filter(~_is_object()).select("source_file", "position", F.lit("not an object").alias("reason"))
    return _fields(records.filter(_is_object())), cut.invalid().unionByName(unread).unionByName(odd)


def _fields(records: DataFrame) -> DataFrame:
    r, is_map = F.col("record"), F.col("is_map")
    species, name = _filled(r, "species"), _filled(r, "name")
    images = F.try_variant_get(r, "$.image_urls", "array<string>")
    return records.select(
        "source_file",
        F.col("position").cast("long").alias("position"),
        F.coalesce(_filled(r, "id"), F.when(is_map, F.col("key")).otherwise(_text(r, "species"))).alias("external_id"),
        # A list record without a usable name takes its species as it stands.
        F.when(is_map, F.coalesce(species, name, F.col("key")))
        .otherwise(F.coalesce(name, _text(r, "species")))
        .alias("name"),
        _text(r, "family").alias("family"),
        _text(r, "order").alias("order"),
        F.coalesce(_filled(r, "image_url"), F.get(images, F.lit(0))).alias("image_url"),
        F.try_variant_get(r, "$.dataset_records", "bigint").alias("dataset_records"),
        F.try_variant_get(r, "$.subrepresented", "boolean").alias("subrepresented"),
    )
