"""python -m graphloom COMMAND ...: the batch steps on stored graphs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.operators import clean, merge, stats
from graphloom.sources import readers, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="take extracted facts (JSON lines) into a graph's state, and write its new version")
    b.add_argument("facts")
    b.add_argument("--state", required=True, help="directory of the builder's versioned state; a batch that is there already is skipped")
    b.add_argument("--batch", type=int, help="number of the batch")
    b.add_argument("--out", required=True)
    b.add_argument("--version", default="v1")
    for name in ("clean", "merge", "stats", "ask", "upload", "eval"):
        c = sub.add_parser(name)
        c.add_argument("graph", help="a graph directory, or a JSON file")
        if name in ("clean", "merge"):
            c.add_argument("--out", help="directory of the new version")
            c.add_argument("--version", default="v2")
            c.add_argument("--dry-run", action="store_true", help="only report")
        if name == "merge":
            c.add_argument("--threshold", type=float, default=0.88)
        if name == "ask":
            c.add_argument("question")
        if name == "upload":
            c.add_argument("--out", required=True, help="directory of the store's batches")
            c.add_argument("--batch-size", type=int, default=500)
        if name == "eval":
            c.add_argument("benchmark", help="questions (JSON lines)")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "build":
        from graphloom.streaming.incremental import GraphBuilder

        g = GraphBuilder(spark, path=a.state).add(readers.extracted_facts(spark, a.facts), a.batch)
        print(sinks.write_graph(g, a.out, a.version))
        return
    g = readers.read_graph_json(spark, a.graph) if a.graph.endswith(".json") else sinks.read_graph(spark, a.graph)
    if a.command == "stats":
        stats.graph_stats(g).show(truncate=False)
        stats.label_histogram(g.nodes).orderBy("label").show(truncate=False)
        stats.relation_histogram(g.edges).show(truncate=False)
    elif a.command == "ask":
        from graphloom.plans.engine import Engine

        answer = Engine(g).ask(a.question)
        print(answer.text, *answer.steps, sep="\n")
    elif a.command == "eval":
        from graphloom.plans import evaluate
        from graphloom.plans.engine import Engine

        evaluate.report(evaluate.run(Engine(g), readers.read_benchmark(spark, a.benchmark))).show(truncate=False)
    elif a.command == "upload":
        stored = sinks.to_store_model(g)
        good, skipped = sinks.loadable_edges(stored)
        sinks.write_batches(stored.nodes, f"{a.out}/nodes", a.batch_size)
        good.write.mode("overwrite").partitionBy("rel").option("maxRecordsPerFile", a.batch_size).parquet(f"{a.out}/edges")
        skipped.show()
    elif a.command == "clean":
        clean.audit(g).show(truncate=False)
        if not a.dry_run:
            print(sinks.write_graph(clean.clean(g), a.out, a.version))
    else:
        merged, plan = merge.merge_entities(g, a.threshold)
        plan.where("id <> to").orderBy("to", "id").show(50, truncate=False)
        if not a.dry_run:
            print(sinks.write_graph(merged, a.out, a.version))


if __name__ == "__main__":
    main()
