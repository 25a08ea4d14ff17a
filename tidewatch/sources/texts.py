"""Sources that are text: server logs, shell and terminal output, JSON answers, connection strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_answer(df: DataFrame, column: str) -> DataFrame:
    """Samples of a time-series answer: [{"metric": {...}, "values": [[seconds, "value"], ...]}, ...]."""
    shape = "array<struct<metric:map<string,string>,values:array<array<string>>>>"
    series = df.select(F.explode(F.from_json(column, shape)).alias("s"))
    pairs = series.select(F.col("s.metric").alias("labels"), F.explode("s.values").alias("p"))
    seconds, text = F.col("p")[0].cast("decimal(20,3)"), F.col("p")[1]
    return pairs.select(
        F.col("labels")["__name__"].alias("name"), F.map_filter("labels", lambda k, v: k != "__name__").alias("labels"),
        (seconds * 1000).cast("long").alias("ts_ms"), F.when(text == "NaN", None).otherwise(text.cast("double")).alias("value"),
    )


def zip_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each place of several lists; shorter ones are filled with NULL."""
    zipped = df.withColumns({f"_{n}": c for n, c in columns.items()}).withColumn("_z", F.explode(F.arrays_zip(*(f"_{n}" for n in columns))))
    return zipped.select(*df.columns, *(F.col(f"_z._{n}").alias(n) for n in columns))


def table_output(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, cells) of a terminal's table: header, rule of dashes, rows with | between cells, (n rows)."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("row", "_line"))
    rows = lines.where("row > 1").where(~F.col("_line").rlike(r"^\(\d+ rows?\)$") & (F.trim("_line") != ""))
    return rows.select(key, (F.col("row") - 2).alias("row"), F.transform(F.split("_line", r"\|"), lambda c: F.trim(c)).alias("cells"))


def dsn_parts(text: Column) -> Column:
    """key=value pairs as a map."""
    return F.str_to_map(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(" "), F.lit("="))


def address_parts(text: Column) -> dict[str, Column]:
    shape = r"^\w+://(?:([^:@/]+)(?::([^@/]*))?@)?([^:/]+)(?::(\d+))?(?:/(\w+))?"
    return {n: F.nullif(F.regexp_extract(text, shape, k), F.lit("")) for k, n in enumerate(("user", "password", "host", "port", "dbname"), 1)}


# --- server logs ---------------------------------------------------------------------------------

#: What a log prefix is made of, by its letter, as a pattern.
PREFIX = {"m": r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?(?: [A-Z]{2,5})?", "t": r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?: [A-Z]{2,5})?", "u": r"\S+", "d": r"\S+", "p": r"\d+", "h": r"\S+", "c": r"\S+", "S": r"\S+", "x": r"\d+"}


def prefix_pattern(prefix: str) -> tuple[str, list[str]]:
    """A pattern for a line's prefix such as '%m %c %d %p', and the letters in order."""
    import re

    out, letters = "^", []
    for literal, letter in re.findall(r"([^%]*)%(\w)|$", prefix):
        if letter:
            out += re.escape(literal) + f"({PREFIX.get(letter, r'[^ ]+')})"
            letters.append(letter)
    return out + r"\s+(.*)$", letters


def log_records(lines: DataFrame, prefix: str, order: str = "line_no", text: str = "value") -> DataFrame:
    """Lines of a log as records: (letters..., message); a line without a prefix continues the record before."""
    pattern, letters = prefix_pattern(prefix)
    headed = F.col(text).rlike(pattern)
    numbered = lines.withColumn("_record", F.count_if(headed).over(Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.select(
        "file", "_record", order, *(F.when(headed, F.regexp_extract(text, pattern, k)).alias(x) for k, x in enumerate(letters, 1)),
        F.when(headed, F.regexp_extract(text, pattern, len(letters) + 1)).otherwise(F.trim(text)).alias("_part"),
    ).where("_record > 0")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_part"))), lambda s: s["_part"]), " ")
    return parts.groupBy("file", "_record").agg(F.min(order).alias(order), *(F.max(x).alias(x) for x in letters), whole.alias("message")).drop("_record")


def log_statements(records: DataFrame, thread: str, order: str = "line_no") -> DataFrame:
    """(file, thread, statement): executed statements with their parameters filled in; BEGIN ... COMMIT is one."""
    from tidewatch.operators.sqltext import fill_parameters

    said = records.withColumn("_sql", F.regexp_extract("message", r"(?:statement|execute [^:]*):\s+(.*)$", 1)).withColumn("_details", F.regexp_extract("message", r"parameters:\s+(.*)$", 1))
    w = Window.partitionBy("file", thread).orderBy(order)
    values = F.transform(F.split(F.lead("_details").over(w), r",\s*(?=\$)"), lambda p: F.trim(F.regexp_replace(p, r"^\$\d+ = ", "")))
    filled = said.withColumn("_values", values).where("_sql <> ''")
    filled = filled.withColumn("_sql", F.when(F.lead("_details").over(w).isNull() | F.col("_values").isNull() | F.col("_values")[0].isin(""), F.col("_sql")).otherwise(fill_parameters(F.col("_sql"), F.col("_values"))))
    up = F.upper(F.trim(F.regexp_replace("_sql", ";", "")))
    depth = F.count_if(up.isin("BEGIN", "START TRANSACTION")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.count_if(up.isin("COMMIT", "ROLLBACK", "END")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    folded = filled.withColumn("_in", depth > 0).withColumn("_tx", F.when(F.col("_in"), F.count_if(up.isin("BEGIN", "START TRANSACTION")).over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(-F.col(order)))
    body = folded.where(~up.isin("BEGIN", "START TRANSACTION", "COMMIT", "ROLLBACK", "END"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_sql"))), lambda s: F.concat(F.regexp_replace(s["_sql"], r"[;\s]+$", ""), F.lit(";"))), "")
    return body.groupBy("file", thread, "_tx").agg(F.min(order).alias(order), joined.alias("statement")).drop("_tx")


def read_log(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Records of log files; a file's lines stay in order, so a file is one task's work."""
    lines = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    numbered = lines.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return log_records(numbered, prefix)


def is_worth_keeping(sql: Column) -> Column:
    """Statements of a workload: data statements, not of the catalogue, not of sessions."""
    up = F.upper(F.ltrim(sql))
    return up.rlike(r"^(SELECT|INSERT|UPDATE|DELETE|WITH|BEGIN)\b") & ~up.rlike(r"\b(PG_|INFORMATION_SCHEMA|GS_)") & ~up.rlike(r"^SELECT\s+\d+\s*;?$")


def data_statements(report: DataFrame, sql: str, micros: str) -> DataFrame:
    """(template, seconds) of the data statements of a load report."""
    from tidewatch.operators.sqltext import templatise

    kept = report.where(F.upper(F.ltrim(sql)).rlike(r"^(SELECT|INSERT|UPDATE|DELETE)\b"))
    return kept.select(templatise(F.col(sql)).alias("template"), (F.col(micros) / 1e6).alias("seconds"))
