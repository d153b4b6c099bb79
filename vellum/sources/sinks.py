"""Writers: JSON reports, progress lines, CSV with quotes, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object for each row; a folder that is there is never overwritten."""
    df.write.mode("errorifexists").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


#: The version of reports' form.
SCHEMA_VERSION = 1


def envelopes(rows: DataFrame, doc: str, kind: str, totals: dict[str, Column]) -> DataFrame:
    """(doc, json): a report for each document: version, kind, its totals, and its rows in the order of their columns.

    A document's rows are one report, so they are gathered; they are as many as it has pages or findings.
    """
    fields = [c for c in rows.columns if c != doc]
    gathered = rows.groupBy(doc).agg(F.struct(*[c.alias(n) for n, c in totals.items()]).alias("totals"), F.sort_array(F.collect_list(F.struct(*fields))).alias("results"))
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(kind).alias("kind"), F.col(doc).alias("document"), "totals", "results")
    return gathered.select(doc, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def benchmark_rows(pages: DataFrame, references: DataFrame) -> DataFrame:
    """Pages (path, page, ...) with how many references they have and pass, and the best one: of those that are OK the least difference, then the least error, then the first by name.

    ``references`` hold (path, page, name, status, passed, diff, mae, rmse, ssim).
    """
    ok = F.col("status") == "OK"
    order = F.struct(F.coalesce("diff", F.lit(float("inf"))), F.coalesce("mae", F.lit(float("inf"))), "name")
    best = F.min_by(F.struct("name", "diff", "mae", "rmse", "ssim"), F.when(ok, order)).alias("best")
    of_page = references.groupBy("path", "page").agg(F.count("*").alias("references"), F.count_if("passed").alias("passing"), F.max(F.when(ok, 1)).alias("_some"), best)
    joined = pages.join(of_page, ["path", "page"], "left")
    named = [F.when(F.col("_some") == 1, F.col(f"best.{c}")).alias(f"best_{c}") for c in ("name", "diff", "mae", "rmse", "ssim")]
    return joined.select(*pages.columns, F.coalesce("references", F.lit(0)).alias("references"), F.coalesce("passing", F.lit(0)).alias("passing"), *named)


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of each row: texts in quotes that are doubled inside, numbers with at most six decimals, nothing for a null."""

    def field(name: str, kind: str) -> Column:
        if kind == "string":
            text = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
            return F.coalesce(text, F.lit('""'))
        return F.coalesce(short_number(F.col(name)) if kind in ("double", "float") else F.col(name).cast("string"), F.lit(""))

    return df.select(F.concat_ws(",", *[field(n, k) for n, k in df.dtypes]).alias("line"))


def benchmark_report(title: str, facts: dict[str, str], sections: dict[str, DataFrame], most: int = 100) -> str:
    """A Markdown report: facts as a list, then each section's first rows as a table."""
    lines = [f"# {title}", "", *[f"- {k}: `{v}`" for k, v in facts.items()], ""]
    for name, df in sections.items():
        lines += [f"## {name}", "", markdown(df, most)]
    return "\n".join(lines)


def short_number(value: Column, digits: int = 6) -> Column:
    """A number with at most so many decimals, without zeros at the end."""
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields with commas, quotes or line ends are quoted and quotes doubled."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    out = df.select(*[short_number(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])
    out.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def markdown(df: DataFrame, most: int = 100) -> str:
    """The first rows as a Markdown table, made on the driver; a report, hence the limit."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)
