"""Delivered CSV files: the entity dictionary and labelled sentences."""

from pyspark.sql import DataFrame, SparkSession

from entitylake.functions.keys import composite_key
from entitylake.schemas import ENTITY_FILE, LABELLED_TEXT


def _csv(spark: SparkSession, path: str | list[str], schema) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=",", multiLine=True)


def read_entity_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Dictionary rows of one or more files (globs allowed); quoted fields may span lines."""
    return _csv(spark, path, ENTITY_FILE)


def read_labelled_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sentences with the number of persons, organisations and places in each, and a key."""
    return _csv(spark, path, LABELLED_TEXT).withColumn("uid", composite_key("data"))
