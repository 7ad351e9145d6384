"""Writers: line files, tables with a byte-order mark, versions, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Lines of JSON; returns the number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def write_once(df: DataFrame, path: str) -> None:
    """Never overwrites; the committer renames only complete output."""
    df.write.mode("errorifexists").parquet(path)


def write_version(df: DataFrame, folder: str) -> str:
    """A new version beside the old ones; the path is returned, nothing is overwritten."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def point_to(spark: SparkSession, folder: str, version: str) -> None:
    """Makes a version the current one: the pointer is written beside and renamed, so readers see the old or the new one."""
    path, fs = _file_system(spark, f"{folder.rstrip('/')}/ACTUAL")
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.exists(path):
        fs.delete(path, False)
    fs.rename(beside, path)


def current_version(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(spark.read.text(f"{folder.rstrip('/')}/ACTUAL").collect()[0].value)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _one_file(df: DataFrame, path: str, kind: str, empty: str = "", **options: str) -> int:
    """Written by one executor task to a folder beside the path, then renamed; returns the number of rows."""
    spark, seen = df.sparkSession, Observation()
    target, fs = _file_system(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).coalesce(1).write.format(kind).options(**options).save(beside)
    folder = spark._jvm.org.apache.hadoop.fs.Path(beside)
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    if fs.exists(target):
        fs.delete(target, False)
    if parts and seen.get["n"]:
        fs.rename(parts[0], target)
    else:
        out = fs.create(target, True)
        out.write(bytearray(empty.encode()))
        out.close()
    fs.delete(folder, True)
    return seen.get["n"]


def write_csv_bom(df: DataFrame, path: str) -> int:
    """One CSV file that spreadsheet programs read as UTF-8; rows stream through one task, none reaches the driver."""
    first, *rest = df.columns
    header = "\ufeff" + ",".join(df.columns) + "\n"
    return _one_file(df.toDF("\ufeff" + first, *rest), path, "csv", header, header="true", emptyValue="", quoteAll="false")


def write_map(df: DataFrame, key: str, value: str, path: str) -> int:
    """A JSON object of two columns, sorted by key; of equal keys all are written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comma = "{"
        for batch in batches:
            lines = []
            for k, v in zip(batch["k"], batch["v"]):
                lines.append(f"{comma} {json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}")
                comma = ","
            yield pd.DataFrame({"line": lines})
        yield pd.DataFrame({"line": ["}" if comma == "," else "{}"]})

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"))
    lines = rows.orderBy("k", "v").coalesce(1).mapInPandas(run, "line string")
    return max(0, _one_file(lines, path, "text", empty="{}") - 1)


def markdown_report(hits: DataFrame, title: str, columns: list[str], most: int | None = None) -> str:
    """A report of all hits, as text; with ``most`` more of them raise."""
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    rows = hits.select(*columns)
    for n, row in enumerate(rows.toLocalIterator() if most is None else rows.limit(most + 1).collect()):
        if most is not None and n >= most:
            raise ValueError(f"more than {most} hits; write a table instead")
        lines.append("| " + " | ".join("" if v is None else str(v).replace("\n", " ").replace("|", "\\|") for v in row) + " |")
    return "\n".join(lines) + "\n"


def fill_page(template: str, parts: dict[str, str], opening: str = "<!--", closing: str = "-->") -> str:
    """A page from a template whose markers, such as ``<!--name-->``, are replaced; a missing or unknown marker raises."""
    page = template
    for name, content in parts.items():
        marker = f"{opening}{name}{closing}"
        if template.count(marker) != 1:
            raise ValueError(f"the template holds {marker} {template.count(marker)} times")
        page = page.replace(marker, content)
    return page


def coding_sheet(sample: DataFrame, code: str, columns: list[str], answers: dict[str, list[str]], path: str, previous: DataFrame | None = None) -> int:
    """One sheet to code by hand: code, columns, an answer column for each list of allowed values (named in its header).

    Answers of an earlier sheet are carried over by their code.
    """
    sheet = carry_answers(sample.select(code, *columns), code, list(answers), previous)
    named = [f"{name} ({' / '.join(values)})" for name, values in answers.items()]
    return write_csv_bom(sheet.orderBy(code).toDF(code, *columns, *named), path)


def carry_answers(sheet: DataFrame, code: str, answers: list[str], previous: DataFrame | None) -> DataFrame:
    """The sheet with the answers that an earlier one holds for the same code, else null."""
    if previous is None:
        return sheet.select("*", *[F.lit(None).cast("string").alias(a) for a in answers])
    kept = previous.groupBy(code).agg(*[F.max(a).alias(a) for a in answers])
    return sheet.join(kept, code, "left")


def read_answers(sheet: DataFrame, answers: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(rows whose answers are all allowed or empty, rows with others), the answer columns under their plain names."""
    renamed = sheet
    for column in sheet.columns:
        name = column.split(" (")[0]
        if name in answers:
            renamed = renamed.withColumnRenamed(column, name)
    wrong = F.lit(False)
    for name, values in answers.items():
        wrong = wrong | (F.col(name).isNotNull() & ~F.col(name).isin(values))
    return renamed.where(~wrong), renamed.where(wrong)
