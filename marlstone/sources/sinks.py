"""Files out: Markdown reports, manifest, index, vectors, archive."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section(title: str, body: Column) -> Column:
    """A section, or null if it has no body."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"## {title}\n\n"), body))


def table(rows: Column, columns: dict[str, str], most: int = 40) -> Column:
    """A Markdown table of an array of structs; a header every ``most`` rows."""
    head = "| " + " | ".join(columns.values()) + " |\n|" + " --- |" * len(columns) + "\n"
    cell = lambda x: F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s*\n\s*|\|", " ")
    line = lambda r, i: F.concat(F.when((i > 0) & (i % most == 0), F.lit("\n" + head)).otherwise(F.lit("")), F.lit("| "), F.concat_ws(" | ", *(cell(r[c]) for c in columns)), F.lit(" |\n"))
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(F.transform(rows, line), "")))


def reports(objects: DataFrame, key: str, title: Column, sections: dict[str, Column]) -> DataFrame:
    """``key`` and ``markdown``, a document an object."""
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), title), *(section(k, v) for k, v in sections.items()))
    return objects.select(key, body.alias("markdown"))


def write_reports(made: DataFrame, key: str, path: str) -> None:
    """A folder for each object, one text file in it."""
    made.select(key, F.col("markdown").alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def manifest(items: DataFrame, started: str, ended: str) -> DataFrame:
    """JSON lines of a batch: a header with its counts, then its items.

    ``pos`` is the place of each, the header's null; one item a row, however
    large the batch.
    """
    head = items.agg(F.lit(started).alias("started"), F.lit(ended).alias("ended"), F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))
    place = items.schema["pos"].dataType
    header = head.select(F.lit(None).cast(place).alias("pos"), F.to_json(F.struct(*head.columns)).alias("line"))
    return header.unionByName(items.select("pos", F.to_json(F.struct(*items.columns)).alias("line")))


def write_manifest(lines: DataFrame, path: str) -> None:
    """The lines in order: range partitions of text files, the header first."""
    lines.orderBy(F.asc_nulls_first("pos")).select("line").write.mode("overwrite").text(path)


def verification(objects: DataFrame, key: str, facts: dict[str, Column], checks: dict[str, Column], findings: Column) -> DataFrame:
    """``key`` and ``markdown``: figures, checks passed or not, findings."""
    rows = lambda named: F.array(*(F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in named.items()))
    passed = {k: F.when(v, "passed").otherwise("failed") for k, v in checks.items()}
    listed = F.array_join(F.transform(findings, lambda f: F.concat(F.lit("- "), f)), "\n")
    columns = {"name": "Item", "value": "Value"}
    return reports(objects, key, F.concat(F.lit("Verification of "), F.col(key).cast("string")), {"Figures": table(rows(facts), columns), "Checks": table(rows(passed), columns), "Findings": listed})


def add_vectors(chunks: DataFrame, path: str) -> None:
    """Adds chunks (id, source, text, embedding) to a store of Parquet files.

    A batch is a file set of its own; an id that is added again is taken from
    the latest batch by ``stored_vectors``.
    """
    chunks.select("id", "source", "text", "embedding", F.current_timestamp().alias("added_at")).write.mode("append").parquet(path)


def stored_vectors(store: DataFrame) -> DataFrame:
    latest = store.groupBy("id").agg(F.max_by(F.struct("source", "text", "embedding"), "added_at").alias("x"))
    return latest.select("id", "x.*")


def index(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots first, then callees, then failures, by name."""
    called = edges.filter("callee is not null").select(F.col("callee").alias("object_id")).distinct().withColumn("called", F.lit(True))
    group = F.when(F.col("status") != "ok", 2).when(F.col("called"), 1).otherwise(0)
    return items.join(called, "object_id", "left").select("object_id", "status", group.alias("group")).orderBy("group", "object_id")


def archive(made: DataFrame, key: str, most: int = 10_000) -> bytes:
    """A ZIP of the reports, for a download; refuses more than ``most``."""
    rows = made.select(key, "markdown").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} reports; write them as files")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for row in sorted(rows):
            z.writestr(f"{row[0]}.md", row[1])
    return out.getvalue()
