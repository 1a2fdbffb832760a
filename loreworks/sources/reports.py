"""Test reports: JUnit XML, JavaScript JSON and cargo text, reduced to one counting table.

Each parser takes {run, raw} and gives {run, passed, failed, skipped, failures, details, duration_s}, where
``failures`` names every failed test, ``details`` has {name, message} of each failure, the first ``MESSAGE``
characters of it, and ``duration_s`` is the time that the suites took (0 where the format does not tell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = 500
_BAD = "array<struct<_VALUE:string,_message:string>>"
_CASE = f"struct<_classname:string,_name:string,failure:{_BAD},error:{_BAD}>"
_SUITE = f"_tests:long,_failures:long,_errors:long,_skipped:long,_time:double,testcase:array<{_CASE}>"
_JUNIT = (
    f"_tests long, _failures long, _errors long, _skipped long, _time double, testcase array<{_CASE}>, "
    f"testsuite array<struct<{_SUITE}>>"
)
_ASSERTIONS = "array<struct<status:string,fullName:string,title:string,failureMessages:array<string>>>"
_JS = (
    "numPassedTests long, numFailedTests long, numPendingTests long, numTodoTests long, startTime double, endTime double, "
    f"testResults array<struct<assertionResults:{_ASSERTIONS}>>"
)
# The lines of a cargo report.
CARGO_LINE = r"test result:\s+\w+\.\s+(\d+) passed;\s+(\d+) failed;\s+(\d+) ignored"
CARGO_NAME = r"(?m)^\s{4}(\S+)$"


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + F.coalesce(v, F.lit(0).cast("long")))


def _detail(name: Column, message: Column) -> Column:
    return F.struct(name.alias("name"), F.substring(F.coalesce(message, F.lit("")), 1, MESSAGE).alias("message"))


def _named(parsed: DataFrame, duration: Column) -> DataFrame:
    """{run, passed, failed, skipped, failures, details, duration_s}."""
    return parsed.select("run", "passed", "failed", "skipped", F.col("details.name").alias("failures"), "details", duration.cast("double").alias("duration_s"))


def parse_junit(reports: DataFrame) -> DataFrame:
    """Counts come from the attributes of every suite, failures from its cases."""
    doc = F.col("_d")
    root = F.struct(*[doc[c].alias(c) for c in ("_tests", "_failures", "_errors", "_skipped", "_time", "testcase")])
    suites = F.coalesce(doc["testsuite"], F.array(root))
    bad = lambda c: F.concat(*[F.coalesce(c[k], F.array().cast(_BAD)) for k in ("failure", "error")])

    def name(c: Column) -> Column:
        whole = F.concat(F.coalesce(c["_classname"], F.lit("")), F.lit("::"), F.coalesce(c["_name"], F.lit("")))
        return F.regexp_replace(whole, "^:+|:+$", "")

    def details(suite: Column) -> Column:
        cases = F.coalesce(suite["testcase"], F.array().cast(f"array<{_CASE}>"))
        # an empty message gives way to the text, as an absent one does
        said = lambda f: F.coalesce(F.nullif(f["_message"], F.lit("")), f["_VALUE"])
        return F.flatten(F.transform(cases, lambda c: F.transform(bad(c), lambda f: _detail(name(c), said(f)))))

    counted = reports.withColumn("_d", F.from_xml("raw", _JUNIT)).withColumn("_s", suites).withColumn("details", F.flatten(F.transform("_s", details)))
    failed = _total(F.transform("_s", lambda s: s["_failures"])) + _total(F.transform("_s", lambda s: s["_errors"]))
    skipped = _total(F.transform("_s", lambda s: s["_skipped"]))
    tests = _total(F.transform("_s", lambda s: s["_tests"]))
    spent = F.aggregate("_s", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["_time"], F.lit(0.0)))
    return _named(counted.withColumns({"passed": tests - failed - skipped, "failed": failed, "skipped": skipped}), spent)


def parse_js_json(reports: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    doc = F.col("_d")
    none = F.array().cast(_ASSERTIONS)
    cases = F.flatten(F.transform(F.coalesce(doc["testResults"], F.array().cast(f"array<struct<assertionResults:{_ASSERTIONS}>>")), lambda s: F.coalesce(s["assertionResults"], none)))
    details = F.transform(
        F.filter(cases, lambda c: c["status"] == "failed"),
        lambda c: _detail(F.coalesce(c["fullName"], c["title"], F.lit("?")), F.get(c["failureMessages"], F.lit(0))),
    )
    parsed = reports.withColumn("_d", F.from_json("raw", _JS)).select(
        "run", "_d", F.coalesce(doc["numPassedTests"], zero).alias("passed"), F.coalesce(doc["numFailedTests"], zero).alias("failed"),
        (F.coalesce(doc["numPendingTests"], zero) + F.coalesce(doc["numTodoTests"], zero)).alias("skipped"),
        details.alias("details"),
    )
    return _named(parsed, F.coalesce(F.greatest(F.lit(0.0), (doc["endTime"] - doc["startTime"]) / 1000), F.lit(0.0)))


def parse_cargo(reports: DataFrame) -> DataFrame:
    """Sums of all summary lines; names are read after the word ``failures:`` when any test failed."""
    part = lambda i: _total(F.transform(F.regexp_extract_all("raw", F.lit(CARGO_LINE), F.lit(i)), lambda v: v.cast("long")))
    has_section = F.contains("raw", F.lit("failures:"))
    names = F.when(
        has_section & (F.col("failed") > 0),
        F.regexp_extract_all(F.try_element_at(F.split("raw", "failures:", 2), F.lit(2)), F.lit(CARGO_NAME), F.lit(1)),
    ).otherwise(F.array().cast("array<string>"))
    parsed = reports.withColumn("failed", part(2)).select("run", part(1).alias("passed"), "failed", part(3).alias("skipped"), names.alias("_names"))
    # the format has no messages that could be told apart
    details = F.transform("_names", lambda n: _detail(n, F.lit("see the log for the assertion")))
    return _named(parsed.withColumn("details", details), F.lit(0.0))


PARSERS = {"junit": parse_junit, "js": parse_js_json, "cargo": parse_cargo}


def read_test_reports(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Reports below ``path``, one per file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.col("value").alias("raw"))
    return PARSERS[fmt](raw)
