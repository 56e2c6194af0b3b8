"""Dimension tables: skills, skill aliases, roles, role aliases.

Dimensions are small by nature (hundreds of rows).  They are read from files
(``load_dimension``) or, for the test tables, built from the literal rows
below.  Their size is fixed by construction, which is what makes the explicit
``F.broadcast`` on them safe; ``check_dimension_size`` guards file-backed ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions.text import normalize_key

# Literal dimensions used with the shared test tables.  They are chosen so the
# three skill-matching tiers, the alias guard, an inactive skill, a name-key
# clash and unmatched role hints all occur on ``documents`` and ``part``.
TEST_SKILLS = [
    # (skill_id, name, is_active)
    ("S01", "Hetition", True),
    ("S02", "besten", True),
    ("S03", "Sur", True),
    ("S04", "Apache Licensing", True),
    ("S05", "English Articles", True),
    ("S06", "Prepositions", True),
    ("S07", "Conjunctions", True),
    ("S08", "Suffix Tion", True),
    ("S09", "French Articles", True),
    ("S10", "Versioning", True),
    ("S11", "German Words", True),
    ("S12", "Retired Skill", False),
    ("S13", "  hetition ", True),
]
TEST_SKILL_ALIASES = [
    # (alias, skill_id)
    ("the", "S05"), ("a", "S05"), ("an", "S05"),
    ("of", "S06"), ("on", "S06"), ("to", "S06"), ("in", "S06"),
    ("and", "S07"), ("nd", "S07"),
    ("tion", "S08"),
    ("la", "S09"), ("de", "S09"), ("les", "S09"),
    ("Version 2.0", "S10"),
    ("nicht", "S11"), ("und", "S11"),
    ("ench", "S12"),
    ("apache license", "S04"),
]
TEST_ROLES = [
    # (role_id, title)
    ("R01", "Ring Specialist"), ("R02", "Widget Engineer"), ("R03", "Bolt Technician"),
    ("R04", "Gear Designer"), ("R05", "Plate Inspector"), ("R06", "Anvil Smith"),
    ("R07", "Rod Fitter"), ("R08", "Gizmo Developer"),
    ("R10", "English Writer"), ("R11", "French Writer"), ("R12", "German Writer"),
]
TEST_ROLE_ALIASES = [
    # (alias, role_id, reviewed)
    ("Small Ring", "R01", True), ("red  widget", "R02", True), ("blue bolt", "R03", True),
    ("HOT GEAR", "R04", False), ("large plate", "R05", True), ("cold anvil", "R06", True),
    ("new rod", "R07", False), ("old gizmo", "R08", True),
    ("en", "R10", True), ("fr", "R11", True), ("de", "R12", False),
    ("blue rod", None, True),
]


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a relation of known size (given as Arrow), so Spark can broadcast it by that size."""
    columns = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame(pa.table(dict(zip(columns, map(list, zip(*rows))))), schema)


def skills_df(spark: SparkSession) -> DataFrame:
    return _small(spark, TEST_SKILLS, "skill_id string, name string, is_active boolean")


def skill_aliases_df(spark: SparkSession) -> DataFrame:
    df = _small(spark, TEST_SKILL_ALIASES, "alias string, skill_id string")
    return df.withColumn("normalized_alias", normalize_key("alias"))


def roles_df(spark: SparkSession) -> DataFrame:
    return _small(spark, TEST_ROLES, "role_id string, title string")


def role_aliases_df(spark: SparkSession) -> DataFrame:
    df = _small(spark, TEST_ROLE_ALIASES, "alias string, role_id string, reviewed boolean")
    return df.withColumn("normalized_alias", normalize_key("alias"))


def load_dimension(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read a dimension file (parquet/csv/json)."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def check_dimension_size(df: DataFrame, max_rows: int = 1_000_000, name: str = "dimension") -> DataFrame:
    """Fail fast when a file-backed dimension is too large to broadcast."""
    n = df.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"{name} has more than {max_rows} rows; refusing to broadcast it")
    return df


def sql_values(rows: list[tuple], columns: list[str]) -> str:
    """The same literal rows as a SQL ``VALUES`` relation (for the DuckDB oracle)."""
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"
