"""python -m marlstone: take SQL files apart, or run a registered query.

    extract PATH... --out FOLDER    tables of objects, parameters, operations, ladders and gates
    query NAME FOLDER [--out PATH]  a query over a folder of tables, shown or written
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import classify, masking, procedures, splitting, sqlops
from marlstone.sources import files


def extracted(objects: DataFrame) -> dict[str, DataFrame]:
    """What is in SQL objects (object_id, code), as tables."""
    code = F.col("code")
    scored = classify.dialects(objects.select("object_id", "code", masking.masked(code, identifiers=True).alias("text"), masking.executable(code).alias("executable")))
    name = classify.object_name(F.col("executable"))
    told = scored.select("object_id", "code", "detected.*", classify.object_type(F.col("executable")).alias("type"), name["schema"].alias("schema"), name["name"].alias("name"))
    spoken = F.when(F.col("dialect") == "ORACLE", "ORACLE").otherwise("TSQL")
    statements = splitting.statements(told.select("object_id", "code", "dialect")).drop("code")
    listed = lambda column, name: objects.select("object_id", column.alias("x")).select("object_id", F.explode(name).alias("y")).select("object_id", "y.*")
    return {
        "objects": told.drop("code"),
        "parameters": listed(procedures.parameters(code), "x.parameters"),
        "operations": sqlops.with_reads_of_writes(sqlops.table_operations(statements, dialect=spoken)).filter("operation is not null"),
        "ladders": listed(procedures.ladders(masking.executable(code)), "x"),
        "gates": listed(procedures.gates(code), "x"),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marlstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract")
    extract.add_argument("paths", nargs="+")
    extract.add_argument("--out", required=True)
    query = commands.add_parser("query")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--out")
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("marlstone").getOrCreate()
    if given.command == "extract":
        for name, table in extracted(files.read_objects(spark, given.paths)).items():
            table.write.mode("overwrite").parquet(f"{given.out}/{name}")
        return
    from marlstone.plans import catalogue

    found = catalogue.queries()[given.name](spark, given.folder)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(50, truncate=60)


if __name__ == "__main__":
    main()
