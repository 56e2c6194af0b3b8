import csv
import os

from pyspark.sql import functions as F

from skillgrid.operators import dedup, ingest

HEADER = ["external_id", "source", "title", "company", "location", "posted_at", "description", "url",
          "salary_min"]


def write_csv(folder, name, header, body):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(body)
    return path


def test_read_csv_keeps_blanks_and_numbers_rows(spark, scratch):
    body = [["1", "s", "t", "c", "l", "2026-05-01", "d", "u", ""],
            ["2", "s", "t", "c", "l", "2026-05-02T09:30:00Z", "multi\nline", "u", "10.5"]]
    path = write_csv(scratch, "a.csv", HEADER, body)
    df = ingest.read_posting_csv(spark, path)
    got = {r["external_id"]: r for r in df.collect()}
    assert got["1"]["salary_min"] == "" and got["1"]["source_row_number"] == 1
    assert got["2"]["description"] == "multi\nline" and got["2"]["source_row_number"] == 2


def test_reasons_in_order(spark):
    rows = [
        ("1", "s", "t", "c", "l", "2026-05-01", "d", "u", ""),
        ("2", "s", "t", "", "l", "2026-05-01", "d", "u", ""),
        ("3", "s", "t", "c", "l", "2026-05-01", "d", " ", ""),
        ("4", "s", "t", "c", "l", "not-a-date", "d", "u", ""),
        ("5", "s", "t", "c", "l", "2026-02-30", "d", "u", ""),
        ("6", "s", "t", "c", "", "2026-05-01", "d", "u", ""),
        ("7", "s", "t", "c", "l", "2026-05-01", "d", "u", "12x"),
        ("8", "s", "!!!", "c", "l", "2026-05-01", "d", "u", ""),
        ("9", "s", "t", "c", "l", "2026-05-01T09:30:00Z", "d", "u", "100"),
        ("10", "s", "t", "c", "l", "2026-05", "d", "u", ""),
        ("", "s", "", "", "l", "bad", "d", "", ""),
    ]
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)],
                               "source_row_number int, " + ", ".join(f"{c} string" for c in HEADER))
    got = {r["source_row_number"]: r["reason"] for r in ingest.validate_postings(df).collect()}
    assert got == {
        1: None, 2: "EMPTY_REQUIRED_FIELD:company", 3: "EMPTY_REQUIRED_FIELD:url",
        4: "INVALID_DATE:posted_at", 5: "INVALID_DATE:posted_at", 6: "CANONICAL_VALIDATION:location",
        7: "CANONICAL_VALIDATION:salary_min", 8: "EMPTY_AFTER_NORMALIZATION:title", 9: None,
        10: "INVALID_DATE:posted_at", 11: "EMPTY_REQUIRED_FIELD:external_id",
    }
    valid, rejected = ingest.split_valid(ingest.validate_postings(df))
    assert valid.count() + rejected.count() == len(rows)
    typed = {r["source_row_number"]: r for r in ingest.to_raw_posting(valid).collect()}
    assert str(typed[9]["posted_at"]) == "2026-05-01" and float(typed[9]["salary_min"]) == 100.0


def test_missing_column_reason(spark):
    df = spark.createDataFrame([(1, "x")], "source_row_number int, external_id string")
    assert ingest.validate_postings(df).first()["reason"] == "MISSING_REQUIRED_FIELD:source"


def test_quarantine_payload(spark):
    df = spark.createDataFrame([(3, "a", "b\"c", "EMPTY")], "source_row_number int, x string, y string, reason string")
    row = ingest.quarantine_rows(df, "job-1").first()
    assert row["row_number"] == 3 and row["raw_payload"] == '{"x":"a","y":"b\\"c"}' and row["pipeline_job_id"] == "job-1"


def test_foreign_adapter(spark):
    cols = ["source_row_number", "posting_id", "platform", "posted_date", "job_title", "company_name",
            "location", "job_description", "job_url", "work_type"]
    data = [
        (1, "p1", "js", "2026-04", "Dev", "Acme", "PH", "python", "u", "full"),
        (2, "p2", "js", "2026-13", "Dev", "Acme", "PH", "python", "u", ""),
        (3, "p3", "js", "2026-04-15", "Dev", " ", "PH", "python", "u", ""),
        (4, "p4", "js", "2026-04-15T10:00:00", "Dev", "Acme", "PH", "python", "u", ""),
    ]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'int' if c == 'source_row_number' else 'string'}" for c in cols))
    got = {r["source_row_number"]: r for r in ingest.adapt_foreign(df).collect()}
    assert got[1]["posted_at"] == "2026-04-01" and got[1]["reason"] is None
    assert got[1]["employment_type"] == "full" and got[2]["employment_type"] is None
    assert got[2]["reason"] == "INVALID_SOURCE_DATE:posted_date"
    assert got[3]["reason"] == "CANONICAL_VALIDATION:company:Input should be a valid string"
    assert got[4]["reason"] == "INVALID_SOURCE_DATE:posted_date"
    # the second candidate is used when the first is absent; a missing field is named with its candidates
    missing = df.drop("job_url").withColumnRenamed("platform", "source_dataset")
    reasons = {r["source_row_number"]: r["reason"] for r in ingest.adapt_foreign(missing).collect()}
    assert reasons[1] == "MISSING_SOURCE_COLUMN:url:url|job_url"
    assert reasons[2] == "INVALID_SOURCE_DATE:posted_date"


def test_dedup_lowest_row_wins_in_any_order(spark):
    base = [(5, "s", "t", "c", "2026-05-01", "e5"), (2, "s", "t", "c", "2026-05-01", "e2"),
            (9, "s", "t", "c", "2026-05-02", "e9"), (1, "x", "t", "c", "2026-05-01", "e1")]
    schema = ("source_row_number int, normalized_source string, normalized_title string, "
              "normalized_company string, posted_at string, external_id string")
    a = dedup.dedup_postings(spark.createDataFrame(base, schema))
    b = dedup.dedup_postings(spark.createDataFrame(list(reversed(base)), schema).repartition(3))
    sa = sorted(r["external_id"] for r in a.collect())
    assert sa == sorted(r["external_id"] for r in b.collect()) == ["e1", "e2", "e9"]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in dedup.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    try:
        dedup.assert_unique(df, ["k"], "lookup")
        raise AssertionError("expected a duplicate error")
    except ValueError as e:
        assert "duplicate" in str(e)
    assert F is not None


def test_row_numbers_exact_across_splits(spark, scratch):
    # a single file read in many small splits still numbers rows 1..n in file order
    body = [[str(i), "s", "t", f"c{i}", "l", "2026-05-01", "d", "u", ""] for i in range(1, 2001)]
    path = write_csv(scratch, "big.csv", HEADER, body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = ingest.read_posting_csv(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 1
        got = {int(r["external_id"]): r["source_row_number"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: i for i in range(1, 2001)}


def test_rows_with_surplus_fields_are_refused(spark, scratch):
    path = os.path.join(scratch, "s.csv")
    good = "s,t,c,l,2026-05-01,d,u"
    lines = ["external_id,source,title,company,location,posted_at,description,url", f"1,{good}", f"2,{good},extra",
             f"3,{good},", f"4,{good},,,", '5,s,t,c,l,2026-05-01,"a, b ""q"", c",u', "6,s,t,c,l,2026-05-01,d",
             f'7,{good},"x, y"', '8,s,"two\nlines, here",c,l,2026-05-01,d,u', f"9,{good}"]
    with open(path, "w", newline="") as f:
        f.write("\n".join(lines) + "\n")
    rows = ingest.read_posting_csv(spark, path)
    got = {r.external_id: r for r in ingest.validate_postings(rows).collect()}
    assert {k: r.source_row_number for k, r in got.items()} == {str(i): i for i in range(1, 10)}
    assert {k for k, r in got.items() if r.reason == "MALFORMED_ROW:surplus_fields"} == {"2", "3", "4", "7"}
    assert got["6"].reason == "EMPTY_REQUIRED_FIELD:url" and got["5"].reason is None and got["8"].reason is None
    assert got["5"].description == 'a, b "q", c'
    valid, rejected = ingest.split_valid(ingest.validate_postings(rows))
    assert ingest.SURPLUS not in ingest.to_raw_posting(valid).columns
    assert "surplus" not in ingest.quarantine_rows(rejected, "j").first().raw_payload
    assert rows.select("source_row_number", "surplus_fields").where("surplus_fields").count() == 4  # pruned reads agree


def test_a_large_file_is_read_by_several_tasks(spark, scratch):
    body = [[str(i), "s", "t", "c", "l", "2026-05-01", "d" * 50, "u", ""] for i in range(30_000)]
    body[12_345] += ["one more"]
    path = write_csv(scratch, "big.csv", HEADER, body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        df = ingest.read_posting_csv(spark, path, multi_line=False)
        assert df.select("source_row_number", "external_id", "surplus_fields").where(
            "source_row_number <> external_id + 1").count() == 0
        assert [r.external_id for r in df.where("surplus_fields").collect()] == ["12345"]
        assert spark.read.option("header", True).csv(path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
