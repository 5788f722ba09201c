"""Suffixes of symbols' names, sorted, so that the names that hold a text are a range of them.

Tables below a folder:

* ``symbols``: the symbols, sorted by lower-cased name and place
* ``suffixes``: suffix (the first REACH characters from each place of a distinct lower-cased name on), name_lower, sorted by suffix

The names that hold a text have a suffix that begins with it: a filter that Parquet's readers compare with the bounds of row
groups.  Of a longer text the first REACH characters are looked up and the names found compared with all of it, so the table
grows linearly with the names' lengths.  An empty text is in every name, so it reads all symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.sizes import broadcast_if_small
from . import lookup

REACH = 32
#: As many names are compared with the bounds of row groups one by one; of more, only the rows are.
FEW = 10


def suffixes(symbols: DataFrame) -> DataFrame:
    """suffix, name_lower of each distinct name and place in it."""
    names = symbols.select(F.lower("name").alias("name_lower")).where("name_lower <> ''").distinct()
    starts = F.transform(F.sequence(F.lit(1), F.char_length("name_lower")), lambda i: F.substr("name_lower", i, F.lit(REACH)))
    return names.select(F.explode(F.array_distinct(starts)).alias("suffix"), "name_lower")


class Names:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.symbols, self.suffixes = (spark.read.parquet(f"{folder}/{t}") for t in ("symbols", "suffixes"))

    @classmethod
    def write(cls, symbols: DataFrame, folder: str) -> Names:
        own = symbols.withColumn("name_lower", F.lower("name"))
        order = ["name_lower", "repo", "path"]
        own.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/symbols")
        stored = symbols.sparkSession.read.parquet(f"{folder}/symbols")
        # a character may begin a large part of all suffixes; with the name beside it, ranges part those, too
        order = ["suffix", "name_lower"]
        suffixes(stored).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/suffixes")
        return cls(symbols.sparkSession, folder)

    def holding(self, text: str) -> DataFrame:
        """name_lower of the distinct names that hold a lower-cased text."""
        found = self.suffixes.where(F.col("suffix").startswith(text[:REACH]))
        found = found if len(text) <= REACH else found.where(F.contains("name_lower", F.lit(text)))
        return found.select("name_lower").distinct()

    def symbols_for(self, query: str) -> DataFrame:
        """The symbols that ``lookup.match_class`` gives a class."""
        text = lookup.unqualified(query)
        if not text:
            return self.symbols
        names = self.holding(text)
        some = [r["name_lower"] for r in names.limit(FEW + 1).collect()]
        if len(some) <= FEW:
            return self.symbols.where(F.col("name_lower").isin(some))
        return self.symbols.join(broadcast_if_small(names), "name_lower", "left_semi")

    def find(self, files: DataFrame, query: str, limit: int = C.SYMBOL_LIST) -> DataFrame:
        """As ``lookup.find_symbols`` over all symbols."""
        return lookup.find_symbols(self.symbols_for(query), files, query, limit)
