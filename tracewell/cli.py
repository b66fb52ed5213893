"""`python -m tracewell.cli generate --manifest target/manifest.json ...`"""

from __future__ import annotations

import argparse
import os
import sys

from tracewell import __version__
from tracewell.sources.project import ProjectError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tracewell", description="Column lineage of a data project.")
    out.add_argument("-V", "--version", action="version", version=__version__)
    commands = out.add_subparsers(dest="command")
    one = commands.add_parser("generate", help="read artifacts, write the lineage file")
    one.add_argument("--project", default=".", help="the project's folder, for seed files and default paths")
    one.add_argument("--manifest", help="default: <project>/target/manifest.json")
    one.add_argument("--compiled", help="folder of compiled SQL, for models whose manifest has none")
    one.add_argument("--catalog", help="default: <project>/target/catalog.json if it is there")
    one.add_argument("--out", help="the lineage file; default: <project>/target/column_lineage.tracewell.json")
    one.add_argument("--report", help="also write a report")
    one.add_argument("--tables", help="also write all tables as Parquet into this folder")
    one.add_argument("--target", default="", help="a name of the target, kept in the file")
    one.add_argument("--no-infer", action="store_true", help="leave models empty whose compile can't be trusted")
    one.add_argument("--indirect", action="store_true", help="also draw what decides rows as edges")
    return out


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if arguments and not arguments[0].startswith("-") and arguments[0] != "generate":
        print(f"unknown command: {arguments[0]}", file=sys.stderr)
        return 2
    options = parser().parse_args(arguments)
    if options.command is None:
        parser().print_help()
        return 0
    from pyspark.sql import SparkSession

    from tracewell.plans.lineage import Options, run_project
    from tracewell.sources import sinks
    from tracewell.sources.project import load

    target = os.path.join(options.project, "target")
    catalog = options.catalog or os.path.join(target, "catalog.json")
    try:
        project = load(options.manifest or os.path.join(target, "manifest.json"), catalog if options.catalog or os.path.exists(catalog) else None, options.compiled, options.project)
        spark = SparkSession.builder.appName("tracewell").getOrCreate()
        found = run_project(spark, project, Options(not options.no_infer, options.indirect))
        document = sinks.write_cache(found, options.out or sinks.default_path(target), options.target, options.indirect)
        print(f"{len(project.nodes)} nodes, {len(document['edges'])} edges")
        if options.report:
            totals = sinks.write_report(found, options.report, project)["totals"]
            print(f"columns covered: {totals['columns_covered']} of {totals['columns_total']}")
        if options.tables:
            sinks.write_tables(found, options.tables)
    except (ProjectError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
