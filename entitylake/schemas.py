"""Table schemas of the three layers."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# Dictionary file as delivered; the loader adds the key.
ENTITY_FILE = T.StructType(_strings("entity_name", "entity_type", "entity_description"))

ARTICLES = T.StructType(
    [T.StructField("uri", T.StringType(), False)]
    + _strings(
        "entity_uri", "entity_name", "title", "description", "content", "url",
        "source_name", "author",
    )
    + [
        T.StructField("published_at", T.TimestampType()),
        T.StructField("ingestion_timestamp", T.TimestampType()),
    ]
)

# One response of a news API as it lands on disk, tagged with the entity that was searched.
ARTICLE_RESPONSE = T.StructType(
    _strings("entity_uri", "entity_name", "language")
    + [
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    _strings("title", "description", "content", "url", "author", "publishedAt")
                    + [T.StructField("source", T.StructType(_strings("name")))]
                )
            ),
        )
    ]
)

MENTIONS = T.StructType(_strings("uri", "entity_text", "entity_type"))

# Labelled sentences: the text and how many names of each type it holds.
LABELLED_TEXT = T.StructType(
    _strings("data")
    + [T.StructField(name, T.IntegerType()) for name in ("persons", "org", "loc")]
)
