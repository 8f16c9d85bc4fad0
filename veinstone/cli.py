"""python -m veinstone.cli COMMAND ...: the pipeline's steps over tables and files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import text as ft
from veinstone.operators import batches, constraints, extraction, flatten, graph, xmlparse, xmlrepair
from veinstone.session import get_session, stored
from veinstone.sources import files, sinks


def _xml(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = files.xml_files(spark, args.input)
    rows = rows.where(F.col("year") == args.year) if args.year else rows
    return rows.withColumn("fixed", xmlrepair.repaired(F.col("xml")))


def repair_xml(spark: SparkSession, args: argparse.Namespace) -> None:
    """Repair the .xml files below INPUT: to a table at OUTPUT, or, as files, in the same tree below OUTPUT, beside the old ones with
    the suffix .fixed, or in their place. Prints how many had relations and kept them."""
    rows = _xml(spark, args)
    if args.files:
        below = F.regexp_replace("path", "^file:/*", "/")
        root = args.input.removeprefix("file://").rstrip("/")
        name = F.substr(below, F.lit(len(root) + 2))
        name = F.concat(name, F.lit(".fixed")) if args.files == "suffix" else name
        fixed = stored(rows.select(name.alias("path"), F.col("fixed").alias("text")), "fixed")
        sinks.write_each(fixed, args.output if args.files == "tree" else args.input)
    else:
        sinks.write_by_year(rows.select("path", "year", "name", F.col("fixed").alias("xml")), args.output)
        rows = rows.select("xml", "fixed")
    has = lambda c: F.count_if(F.col(c).contains("<Relationship>"))
    if args.files != "replace":
        print(rows.agg(F.count(F.lit(1)).alias("files"), has("xml").alias("with_relations"), has("fixed").alias("kept")).toJSON().first())


def convert_xml(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parse the .xml files below INPUT to report graphs, routed by status, at OUTPUT."""
    graphs = _xml(spark, args).withColumn("graph", xmlparse.parse_xml(F.col("fixed"))).withColumn("status", xmlparse.status_of(F.col("graph")))
    sinks.write_routed(graphs.select("year", "name", "status", "graph.Entities", "graph.Relationships"), args.output)


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Extract entities of the reports <year>/<name>.txt below INPUT to report graphs at OUTPUT, with statistics of the run."""
    rows = files.report_tree(spark, args.input)
    rows = rows.where(F.col("year") == args.year) if args.year else rows
    found = stored(extraction.extract(rows, files.template(spark, args.template) if args.template else "{input}"), "extracted")
    sinks.write_routed(found.select("year", "name", "status", "graph.Entities", "graph.Relationships"), args.output)
    sinks.write_stats(batches.run_stats(found, size="text"), f"{args.output}-stats")


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Batch requests, one JSON line a report, of the reports below INPUT at OUTPUT; prints how many are valid."""
    rows = files.report_tree(spark, args.input).where(F.trim("text") != "")
    rows = rows.where(F.col("year") == args.year) if args.year else rows
    key = ft.custom_id(F.col("year"), F.col("name"), F.col("path"))
    template = files.template(spark, args.template) if args.template else "{input}"
    lines = stored(rows.select(batches.request_line(key, args.system, template, F.col("text"), args.model).alias("value")), "requests")
    sinks.write_lines(lines, args.output)
    print(batches.line_counts(lines).toJSON().first())


def process(spark: SparkSession, args: argparse.Namespace) -> None:
    """Replies, JSON lines at INPUT, to XML by year at OUTPUT, with statistics of the run beside it; broken lines count as failed."""
    rows = files.json_lines(spark, args.input, batches.RESPONSE.replace(", _corrupt_record string", ""))
    broken = F.col("_corrupt_record").isNotNull()
    rows = rows.select(F.xxhash64("value").alias("response_id"), "custom_id", "response", broken.alias("broken"))
    parsed = batches.parse_replies(rows.where("not broken"))
    parsed = stored(parsed.unionByName(rows.where("broken").select("response_id", F.lit("BROKEN").alias("status")), allowMissingColumns=True), "replies")
    sinks.write_by_year(parsed.where("status = 'SUCCESS'").select("year", "custom_id", "xml"), args.output)
    stats = batches.run_stats(parsed)
    sinks.write_stats(stats, f"{args.output}-stats")
    print(stats.toJSON().first())


def flatten_graphs(spark: SparkSession, args: argparse.Namespace) -> None:
    """Flatten report graphs of the Parquet table INPUT (graph_id, graph_json) to tables at OUTPUT."""
    flatten.write_tables(flatten.flatten_graphs(spark.read.parquet(args.input)), args.output)


def _tables(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{args.input}/entities").withColumn("pos", F.col("mention_id")), spark.read.parquet(f"{args.input}/relationships").withColumn("pos", F.col("relationship_key"))


def fix_relations(spark: SparkSession, args: argparse.Namespace) -> None:
    """Correct the relations of INPUT/entities and INPUT/relationships, to OUTPUT, by the year they have if they have one."""
    from veinstone.vocab import TYPE_ALIASES

    checked = constraints.check_relations(*_tables(spark, args), TYPE_ALIASES if args.aliases else None)
    writer = checked.write.partitionBy("year") if "year" in checked.columns else checked.write
    writer.parquet(args.output, mode="overwrite")


def load_graph(spark: SparkSession, args: argparse.Namespace) -> None:
    """Merge nodes and edges of INPUT/entities and INPUT/relationships into the graph at OUTPUT: what is there stays, of equal keys the
    later load holds."""
    entities, relations = _tables(spark, args)
    load = F.current_timestamp().alias("loaded_at")
    nodes = stored(graph.merge_nodes(entities), "nodes")
    named = nodes.select("label", "name").unionByName(graph.missing_endpoints(entities, relations)).distinct()
    bare = named.join(nodes.select("label", "name"), ["label", "name"], "left_anti")
    sinks.merge_table(spark, f"{args.output}/nodes", nodes.unionByName(bare, allowMissingColumns=True).select("*", load), ["label", "name"], "loaded_at")
    edges = graph.merge_edges(named, relations).select("*", load)
    sinks.merge_table(spark, f"{args.output}/edges", edges, ["source_label", "source_name", "type", "target_label", "target_name"], "loaded_at")


def clear_graph(spark: SparkSession, args: argparse.Namespace) -> None:
    """Statistics of the graph at INPUT with --stats; with --confirm its tables are emptied, or with --properties only what nodes hold."""
    nodes, edges = spark.read.parquet(f"{args.input}/nodes"), spark.read.parquet(f"{args.input}/edges")
    if args.stats or not args.confirm:
        print(graph.clear_statistics(nodes, edges).toJSON().first())
    if not args.confirm:
        return print("nothing was cleared; --confirm clears")
    if args.properties:
        return sinks.replace_table(spark, f"{args.input}/nodes", graph.clear_properties(nodes))
    for name, rows in zip(("nodes", "edges"), graph.clear_graph(nodes, edges, True)):
        sinks.replace_table(spark, f"{args.input}/{name}", rows)


def route_ocr(spark: SparkSession, args: argparse.Namespace) -> None:
    """Which PDF files below INPUT need recognition, by their first pages, to OUTPUT."""
    rows = files.pdf_documents(spark, args.input)
    pages = F.split("page_content", "\n")
    rows.select("source", "year", ft.needs_ocr(pages).alias("needs_ocr")).write.parquet(args.output, mode="overwrite")


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    """Run the registered query --name over the tables in INPUT, to OUTPUT."""
    from importlib import import_module

    from veinstone.plans.registry import QUERIES

    found = QUERIES.get(args.name)
    if found is None:  # queries of other subpackages are looked up by the module that --module names
        found = import_module(args.module).QUERIES[args.name] if args.module else None
    if found is None:
        raise SystemExit(f"no query {args.name}; there are {json.dumps(sorted(QUERIES))}")
    found(spark, args.input).write.parquet(args.output, mode="overwrite")


COMMANDS = {
    "repair-xml": repair_xml, "convert-xml": convert_xml, "extract": extract, "prepare": prepare, "process": process, "flatten": flatten_graphs, "fix-relations": fix_relations,
    "load-graph": load_graph, "clear-graph": clear_graph, "route-ocr": route_ocr, "query": query,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veinstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in COMMANDS.items():
        command = commands.add_parser(name, help=run.__doc__)
        command.add_argument("input")
        if name != "clear-graph":
            command.add_argument("output", nargs="?" if name == "repair-xml" else None)
        command.add_argument("--year", type=int, help="only this year")
    options = commands.choices
    options["repair-xml"].add_argument("--files", choices=["tree", "suffix", "replace"], help="write files instead of a table")
    for name in ("extract", "prepare"):
        options[name].add_argument("--template", help="file with a prompt that holds {input}")
    options["prepare"].add_argument("--system", default="You extract entities and relations.")
    options["prepare"].add_argument("--model", default="any")
    options["fix-relations"].add_argument("--aliases", action="store_true", help="read alias entity types as what they stand for")
    options["clear-graph"].add_argument("--stats", action="store_true")
    options["clear-graph"].add_argument("--confirm", action="store_true")
    options["clear-graph"].add_argument("--properties", action="store_true", help="null what nodes hold, keep nodes and edges")
    options["query"].add_argument("--name", required=True)
    options["query"].add_argument("--module", help="module with further QUERIES")
    args = parser.parse_args(argv)
    COMMANDS[args.command](get_session(), args)


if __name__ == "__main__":
    main()
