"""What several operators share: reading tables, word and line rules as column expressions, tables in the shared folder."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..session import checkpoint_ready

#: Fixed values of the contracts: white space, and the words between it.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Everything in ASCII that is no digit and no lower-case letter separates words of the decontamination contract.
NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, to count words only.
ANY_CASE_NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body and the lambdas in it use it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column, separator: str = SPACE_RUN) -> Column:
    """The words of a text as an array; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def row_key(*columns: str) -> Column:
    """A fixed-width stand-in for long texts in joins and groups; used next to the row's id."""
    return F.xxhash64(*[F.col(c) for c in columns])


class Workspace:
    """Tables in the folder that the driver and all executors share, so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_ready(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and read it back."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later job reads."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path(name))
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
