"""Reading and writing records: JSON envelopes, review sheets, Parquet; staged publication and upserts.

Schemas are declared, never inferred; a row that does not fit lands in `_corrupt_record`. Ingest stamps input_index,
the only order that ties may fall back to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions.names import csv_safe
from leadspark.functions.numeric import coerce_range
from leadspark.functions.tristate import known_text, tri_state
from leadspark.operators.publish import upsert

#: The fields of a record document as written; quantities stay JSON text until they are coerced.
RECORD = "id string, company_name string, website string, country string, company_type string, product_categories array<string>, certifications array<string>, certifications_verified string, oem_odm string, private_label string, moq string, lead_time_days string, status string, qualification_score int, evidence array<struct<evidence_id:string,claim:string,value:string,source_url:string,source_tier:int,is_official:boolean,observed_at:string,source_date:string,confidence:decimal(3,2),inferred:boolean,stale:boolean,conflicts_with:array<string>>>"
ENVELOPE = f"records array<struct<{RECORD.replace(' array<', ':array<').replace(' string', ':string').replace(' int,', ':int,')}>>, as_of string, _corrupt_record string"
REVIEW = "record_id string, entity_type string, company_name string, website string, country string, verdict string, reason_code string, note string, reviewer_role string, reviewed_on string"
REVIEW_COLUMNS = [c.split()[0] for c in REVIEW.split(", ")]


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON documents of the form {records: [...], as_of}; one row a record with its document and place. A
    document that can't be read, or holds no records, is one row with `_corrupt_record`, its text, and no input_index, so that none is lost."""
    docs = spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    docs = docs.withColumn("document", F.input_file_name())
    rows = docs.select("document", "as_of", "_corrupt_record", F.posexplode_outer("records").alias("input_index", "r"))
    return rows.select("document", "as_of", "_corrupt_record", F.col("input_index").cast("long").alias("input_index"), "r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines; duplicates of an id are kept for the caller to refuse."""
    return spark.read.schema(RECORD + ", _corrupt_record string").json(path)


def typed(records: DataFrame) -> DataFrame:
    """Unknowns to NULL, flags to nullable booleans, quantities to (min, max, unit, error)."""
    texts = {c: known_text(F.col(c)) for c in ("company_name", "website", "country", "company_type", "status")}
    flags = {c: tri_state(F.col(c)) for c in ("certifications_verified", "oem_odm", "private_label")}
    return records.withColumns(texts | flags | {c: coerce_range(F.col(c)) for c in ("moq", "lead_time_days")})


def evidence_of(records: DataFrame) -> DataFrame:
    """The evidence of records as a table of its own."""
    e = records.select(F.col("id").alias("owner_id"), F.explode("evidence").alias("e")).select("owner_id", "e.*")
    day = lambda c: F.to_date(F.when(F.left(F.col(c), F.lit(10)).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.left(F.col(c), F.lit(10))))
    return e.withColumn("source_date", day("source_date")).withColumn("observed_on", day("observed_at"))


def duplicate_ids(records: DataFrame, key: str = "id") -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet: verdicts in lower case, blanks as NULL."""
    sheet = spark.read.schema(REVIEW).option("header", True).option("enforceSchema", False).option("multiLine", True).csv(path)
    return sheet.withColumn("verdict", F.lower(known_text(F.col("verdict"))))


def unknown_reviews(reviews: DataFrame, scored: DataFrame) -> DataFrame:
    """Reviews of ids that were never scored."""
    return reviews.join(scored.select("record_id"), "record_id", "left_anti")


def write_sheet(rows: DataFrame, path: str) -> None:
    """A review sheet with its fixed columns, guarded against formulas."""
    cells = [csv_safe(F.col(c)).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS]
    rows.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; the order of keys is that of the columns."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def publish(rows: DataFrame, path: str, violations: DataFrame | None = None) -> bool:
    """Write to a staging folder beside the path and move it there only if no violation is found: what is invalid
    never stands at the path. What stood there is moved aside first and deleted last, and moved back if the new can't
    come, so that a failure never loses it. Rename is within one file system."""
    if violations is not None and not violations.isEmpty():
        return False
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    staging, aside = f"{path.rstrip('/')}.staging-{mark}", f"{path.rstrip('/')}.old-{mark}"
    rows.write.parquet(staging)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = at(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stood = fs.exists(target)
    if stood and not fs.rename(target, at(aside)):
        return False
    if not fs.rename(at(staging), target):
        if stood:
            fs.rename(at(aside), target)
        return False
    if stood:
        fs.delete(at(aside), True)
    return True


def merge(existing: DataFrame, incoming: DataFrame, ranks: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert, and each incoming row's outcome; refused rows leave the stored ones as they are."""
    outcomes = upsert(existing, incoming, ranks)
    taken = outcomes.where("outcome in ('created', 'updated')").select("id", "score", "status")
    kept = existing.select("id", "score", "status").join(taken.select("id"), "id", "left_anti")
    return kept.unionByName(taken), outcomes


def write_rows(rows: DataFrame, path: str, guard: bool = True) -> None:
    """Text rows as CSV with a header, guarded against formulas unless the reader is no spreadsheet."""
    cells = [csv_safe(F.col(c)).alias(c) for c in rows.columns] if guard else rows.columns
    rows.select(*cells).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)
