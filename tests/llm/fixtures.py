"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, d string, h string, __t string, kind string, score string, fp string"
SMALL = "/root/testdata/sf0.001"


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (doc_id, text[, lang[, source]]); the other columns have names that operators might use."""
    full = [(r[0], r[1], *(r[2:] + (None, None))[:2], len(r[1]) if r[1] else None, "b", "d", "h", "t", "k", "s", "f") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "the quick brown fox jumps over the lazy dog and runs away from the angry bear " * 3000
ODD = [(1, None, "en", "web"), (2, "", None, None), (3, "one", "en", None), (4, LONG, "en", "web"), (4, LONG, "en", "web"), (5, " \n\t ", None, "web"), (None, "no id here, but some words all the same", "en", "web"), (6, "Übergröße naïve — 日本語テキスト \U0001f600 done", "de", "x"), (7, "tie words here now", "en", "web"), (8, "tie words here now", "en", "web")]


def small(spark: SparkSession, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
