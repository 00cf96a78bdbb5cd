"""A stored index for the similarity join, so that new texts are compared without comparing old ones again.

The index keeps the signatures of its texts and the order of tokens they were made with. The order is
that of the version's first texts and stays: it decides how selective a key is, not what is found,
as long as both sides use the same one. A token that is not in it counts as the rarest. New texts get
their signatures by that order and meet the stored ones and each other; pairs of
stored texts are not formed again. ``rebuild`` makes a new version when the order has aged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.operators import fuzzy_join as joins
from entitylake.operators.hot_keys import CHUNK_ROWS
from entitylake.sources.store import LayerStore

PARTS = ("order", "texts", "short", "long", "pairs")


@dataclass
class SimilarityIndex:
    """Texts, signatures and pairs in the file tables ``{name}_texts`` ... of a store."""

    store: LayerStore
    name: str
    threshold: float = 80
    hot_rows: int = joins.HOT_ROWS
    chunk_rows: int = CHUNK_ROWS

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    def _read(self, part: str) -> DataFrame:
        return self.store.read(self._table(part))

    @property
    def _bounds(self) -> joins._Bounds:
        return joins._Bounds(self.threshold)

    def exists(self) -> bool:
        return self.store.version(self._table("pairs")) > 0

    def _signed(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Short and long signatures of measured texts in the stored order of tokens."""
        short = texts.where(F.col("n") <= joins.PAIR_KEYS_LENGTH)
        tokens = joins._exploded_tokens(short, self._bounds)
        rows = tokens.select("token").distinct().join(self._read("order"), "token", "left")
        ordered = joins._ordered(tokens, rows.select("token", F.coalesce("rows", F.lit(0)).alias("rows")))
        return (
            joins._signatures(ordered, self._bounds, self.hot_rows),
            joins._long_signatures(texts, self._bounds),
        )

    def _between(self, short: DataFrame, long: DataFrame, others: bool) -> DataFrame:
        """Pairs of signed texts with the stored ones, or with each other."""
        theirs = (self._read("short"), self._read("long")) if others else (None, None)
        met = joins._short_pairs(short, theirs[0], self._bounds, self.chunk_rows)
        return joins._scored(met).unionByName(joins._long_pairs(long, theirs[1], self._bounds, self.chunk_rows))

    def rebuild(self, df: DataFrame, text: str, sources: tuple[str, ...] = ()) -> None:
        """A new version with the texts of a column: their own frequencies make the order."""
        texts = joins._measured(df, text)
        tokens = joins._exploded_tokens(texts.where(F.col("n") <= joins.PAIR_KEYS_LENGTH), self._bounds)
        self.store.write(joins._token_rows(tokens), self._table("order"))
        self.store.write(texts, self._table("texts"))
        short, long = self._signed(self._read("texts"))
        self.store.write(short, self._table("short"))
        self.store.write(long, self._table("long"))
        pairs = self._between(self._read("short"), self._read("long"), others=False)
        self.store.write(pairs, self._table("pairs"), sources=sources)

    def add(self, df: DataFrame, text: str, sources: tuple[str, ...] = ()) -> None:
        """Take in the texts of a column that the index does not have, and their pairs."""
        if not self.exists():
            return self.rebuild(df, text, sources)
        known = self._read("texts").select(F.col("text").alias(text))
        new = joins._measured(df.join(known, text, "left_anti"), text)
        # Written first, as signatures and pairs are both made from them. Texts are taken in last,
        # so that a run that failed before is done again.
        self.store.write(new, self._table("arriving"))
        new = self.store.read(self._table("arriving"))
        short, long = self._signed(new)
        self.store.write(short, self._table("arriving_short"))
        self.store.write(long, self._table("arriving_long"))
        short, long = self.store.read(self._table("arriving_short")), self.store.read(self._table("arriving_long"))
        found = self._between(short, long, others=True).unionByName(self._between(short, long, others=False))
        self.store.write(found, self._table("pairs"), mode="append", sources=sources)
        self.store.write(short, self._table("short"), mode="append")
        self.store.write(long, self._table("long"), mode="append")
        self.store.write(new, self._table("texts"), mode="append")

    def match(self, df: DataFrame, text: str) -> DataFrame:
        """(left_text, right_text, score): texts of the index that match those of a column, which is not taken in."""
        texts = joins._measured(df, text)
        short, long = self._signed(texts)
        unequal = self._between(short, long, others=True).select(
            F.col("right_text").alias("left_text"), F.col("left_text").alias("right_text"), "score"
        )
        equal = texts.join(self._read("texts").select("text"), "text").select(
            F.col("text").alias("left_text"), F.col("text").alias("right_text"), F.lit(100.0).alias("score")
        )
        return unequal.unionByName(equal)

    def pairs(self) -> DataFrame:
        """All matching pairs within the index as of :func:`~entitylake.operators.fuzzy_join.similar_texts`."""
        x, y = F.col("left_text"), F.col("right_text")
        # A pair is listed once more if an addition that failed midway was done again.
        once = self._read("pairs").select(F.least(x, y).alias("left_text"), F.greatest(x, y).alias("right_text"), "score").distinct()
        orders = F.array(F.struct(x, y), F.struct(y.alias("left_text"), x.alias("right_text")))
        equal = self._read("texts").select(
            F.col("text").alias("left_text"), F.col("text").alias("right_text"), F.lit(100.0).alias("score")
        )
        return once.select(F.explode(orders).alias("pair"), "score").select("pair.*", "score").unionByName(equal.distinct())
