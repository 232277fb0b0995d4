"""JSON records, GeoJSON features and XML record elements as literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sedgetable.core import SRC, TableError
from sedgetable.sources.elements import Documents, numbered_elements
from sedgetable.sources.markup import xml_records
from sedgetable.sources.numbering import number_records, with_position

RECORDS = "array<map<string,string>>"


def _keys_in_order(records: DataFrame, column: str) -> list[str]:
    """Union of keys in first-seen order. The names are the header, so their number is checked."""
    keys = records.select("__file", "__at", F.posexplode(F.map_keys(column)).alias("i", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("__file", "__at", "i")).alias("first"))
    names = [r["key"] for r in first.orderBy("first").collect()]
    if not names:
        raise TableError("records have no keys")
    return names


def _literal(record: str, name: str):
    return F.coalesce(F.try_element_at(F.col(record), F.lit(name)), F.lit("")).alias(name)


def json_tables(spark: SparkSession, path: str) -> DataFrame:
    """Tables found in JSON documents: ``records`` for a top-level array, else one per array member.

    Members that are no array of objects have no records.
    """
    documents = Documents(spark, path)
    found = documents.elements().groupBy(F.col("member").alias("table")).agg(F.count("*").alias("records"))
    named = documents.members().select(F.col("name").alias("table")).distinct()
    return named.join(found, "table", "full").select("table", F.coalesce("records", F.lit(0)).alias("records"))


def _records(documents: Documents, member: str) -> DataFrame:
    numbered = numbered_elements(documents.elements().filter(F.col("member") == member), documents.splits)
    return numbered.select(SRC, F.lit(0).alias("__file"), F.col(SRC).alias("__at"), "text")


def json_scan(spark: SparkSession, path: str, table: str = "records") -> DataFrame:
    """One literal table of JSON documents: nested values stay JSON text, null and absent are blank."""
    records = _records(Documents(spark, path), table).withColumn("record", F.from_json("text", "map<string,string>"))
    names = _keys_in_order(records, "record")
    return records.select(SRC, *[_literal("record", n) for n in names])


def json_lines_scan(spark: SparkSession, path: str) -> DataFrame:
    """The same table from one record per line, which splits and scales freely."""
    lines = number_records(with_position(spark.read.text(path)))
    records = lines.select(SRC, F.col("__file"), F.col(SRC).alias("__at"), F.from_json("value", "map<string,string>").alias("record"))
    names = _keys_in_order(records, "record")
    return records.select(SRC, *[_literal("record", n) for n in names])


def geojson_scan(spark: SparkSession, path: str) -> DataFrame:
    """Feature properties with ``_feature_id`` and literal ``_geometry_json``; no reference system is assumed."""
    documents = Documents(spark, path)
    collection = F.max((F.col("name") == "type") & F.startswith("value", F.lit('"FeatureCollection"')))
    whole = documents.members().groupBy("file").agg(collection.alias("type"), F.max((F.col("name") == "features") & F.startswith("value", F.lit("["))).alias("features"))
    good = whole.filter("type and features").count()
    if not good or good < documents.starts.select("file").distinct().count():
        raise TableError("only FeatureCollection documents are supported")
    feature = F.from_json("text", "struct<id:string,geometry:string,properties:map<string,string>>")
    features = _records(documents, "features").withColumn("f", feature)
    records = features.select(SRC, "__file", "__at", F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("record"), "f.id", "f.geometry")
    names = _keys_in_order(records, "record")
    if {"_feature_id", "_geometry_json"} & set(names):
        raise TableError("a property uses a reserved column name")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.select(SRC, *[_literal("record", n) for n in names], blank("id").alias("_feature_id"), blank("geometry").alias("_geometry_json"))


def xml_scan(spark: SparkSession, path: str, record: str | Sequence[str]) -> DataFrame:
    """Flat record elements at one exact path: ``@attributes`` and children become columns in first-seen order.

    ``record`` is ``/root/record``, a list of expanded names, or a bare name that only one path ends in. Children
    that are nested, repeated or carry attributes, and text beside children, are refused. Absent and empty are blank.
    """
    numbered = numbered_elements(xml_records(spark, path, record))
    records = numbered.select(SRC, F.lit(0).alias("__file"), F.col(SRC).alias("__at"), "record")
    names = _keys_in_order(records, "record")
    if SRC in names:
        raise TableError("a child uses a reserved column name")
    return records.select(SRC, *[_literal("record", n) for n in names])
