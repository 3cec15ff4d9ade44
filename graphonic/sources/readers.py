"""Readers: Parquet tables, spec JSON, lexicon TSV, region-profile CSV; JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPEC_SCHEMA = "code string, name string, script string, family string, clade boolean, parent string, quality string, script_type string, iso639_3 string, location struct<lat: double, lon: double>, timespan struct<start: int, end: int>, graphemes map<string, array<string>>, allophones map<string, array<string>>, _corrupt string"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def specs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each spec file, with an explicit schema; what does not parse keeps its text in _corrupt."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(SPEC_SCHEMA).json(path)


def listed(spec_rows: DataFrame, include_clades: bool = False) -> DataFrame:
    """Codes in order; clades only if asked for."""
    kept = spec_rows if include_clades else spec_rows.where(~F.coalesce("clade", F.lit(False)))
    return kept.select("code").orderBy("code")


def failures(spec_rows: DataFrame) -> DataFrame:
    """(code, error): files that do not parse, fields that are missing, patterns that do not fit, parents that are not there."""
    check = lambda bad, text: spec_rows.where(bad).select("code", F.lit(text).alias("error"))
    known = spec_rows.select(F.col("code").alias("parent"))
    orphans = spec_rows.where("parent is not null").join(known, "parent", "left_anti").select("code", F.concat(F.lit("parent does not load: "), "parent").alias("error"))
    return check(F.col("_corrupt").isNotNull(), "unreadable").unionByName(check(F.col("code").isNull() | (F.col("code") == ""), "code is missing")).unionByName(check(F.col("name").isNull() | (F.col("name") == ""), "name is missing")).unionByName(check(F.col("iso639_3").isNotNull() & ~F.col("iso639_3").rlike(r"\A[a-z]{3}\z"), "iso639_3: pattern")).unionByName(orphans)


def lexicon_of_lines(lines: DataFrame) -> DataFrame:
    """(word, ipa, line) from numbered lines: exactly one tab, both sides filled; the first entry of a word wins."""
    parts = F.split("text", "\t", -1)
    rows = lines.select("line", parts.alias("p")).where((F.size("p") == 2) & (F.get("p", 0) != "") & (F.get("p", 1) != ""))
    return rows.groupBy(F.get("p", 0).alias("word")).agg(F.min_by(F.get("p", 1), "line").alias("ipa"), F.min("line").alias("line"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon TSV file; lines are numbered in file order."""
    return lexicon_of_lines(spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text")))


def lexicon_problems(lines: DataFrame) -> DataFrame:
    """(line, reason) of each line that is no entry."""
    n = F.size(F.split("text", "\t", -1))
    reason = F.when(F.trim("text") == "", None).when(n < 2, "no tab").when(n > 2, "more than one tab").when(F.get(F.split("text", "\t"), 0) == "", "empty word").when(F.get(F.split("text", "\t", -1), 1) == "", "empty reading")
    return lines.select("line", reason.alias("reason")).where("reason is not null")


def region_profile(spark: SparkSession, path: str, region: str) -> DataFrame:
    """(key, rate) of the first row whose region contains the given text: YES is 1, counts are shares of ipa_chars."""
    rows = spark.read.option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id())
    first = rows.where(F.lower("region").contains(region.lower())).orderBy("_row").limit(1)
    keys = [c for c in rows.columns if c not in ("region", "ipa_chars", "_row")]
    value = lambda c: F.when(F.upper(c) == "YES", 1.0).when(F.upper(c) == "NO", 0.0).otherwise(F.round(F.col(c).try_cast("double") / F.col("ipa_chars").try_cast("double"), 6))
    return first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), value(c).alias("rate")) for c in keys])).alias("x")).select("x.*")


def to_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON, nulls written."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def ordered(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """The first row of each key by a column."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_n = 1").drop("_n")
