"""python -m tarnfold COMMAND: fetch, load, parse, chunk, index, search, ask, eval, experiments."""

from __future__ import annotations

import argparse
import sys

from . import reports
from .api import Engine
from .config import STRATEGIES, Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnfold", description=__doc__)
    p.add_argument("--root", default="file:///tmp/tarnfold", help="folder of collections and caches")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, strategy: bool = False, filters: bool = False):
        c = commands.add_parser(name)
        for x in positional:
            c.add_argument(x)
        if strategy:
            c.add_argument("--strategy", choices=STRATEGIES)
        if filters:
            c.add_argument("--k", type=int)
            c.add_argument("--mmr", action="store_true")
            c.add_argument("--rerank", action="store_true")
            for x in ("language", "symbol_type", "directory"):
                c.add_argument(f"--{x.replace('_', '-')}", default="")
        return c

    fetch = command("fetch", "url", "folder")
    fetch.add_argument("--ref")
    command("load", "tree")
    command("parse", "tree")
    command("chunk", "tree", strategy=True)
    command("index", "tree", strategy=True).add_argument("--name")
    command("search", "name", "question", filters=True)
    command("ask", "name", "question", filters=True)
    command("eval", "name", "gold", filters=True)
    command("experiments", "tables").add_argument("--only", nargs="*")
    return p


def options_of(args) -> dict:
    from .operators.retrieval import overlap_score

    return {"k": args.k, "mmr": args.mmr, "rerank": overlap_score if args.rerank else None, "language": args.language, "symbol_type": args.symbol_type, "directory": args.directory}


def run(engine: Engine, args) -> str:
    from .operators import evaluation

    match args.command:
        case "fetch":
            return engine.fetch(args.url, args.folder, args.ref)
        case "load":
            return evaluation.markdown(engine.load(args.tree).groupBy("language").count().orderBy("language"))
        case "parse":
            return evaluation.markdown(engine.parse(args.tree).groupBy("language", "symbol_type").count().orderBy("language", "symbol_type"))
        case "chunk":
            from .operators import chunking

            return evaluation.markdown(chunking.token_stats(engine.chunk(args.tree, args.strategy).select("strategy", chunking.X.token_estimate(chunking.F.col("embed_text")).alias("n")), "strategy"))
        case "index":
            from .sources.collection import report_text

            report, counters, seconds = engine.index(args.tree, args.strategy, args.name)
            return f"{report_text(report)}; vectors: {counters}; {seconds:.1f} s"
        case "search":
            return reports.hits_text(engine.search(args.name, [args.question], **options_of(args)))
        case "ask":
            row = engine.ask(args.name, [args.question], **options_of(args)).first()
            return f"{row.text}\n\ngrounded {len(row.grounded)}, drifted {len(row.drifted)}, invented {len(row.invented)}, bad references {len(row.bad_refs)}"
        case "experiments":
            from .plans import registry

            known = registry.queries()
            return "\n\n".join(f"## {n}\n\n{evaluation.markdown(known[n](engine.spark, args.tables))}" for n in args.only or registry.EXPERIMENTS)
        case _:
            row = engine.evaluate(args.name, args.gold, **options_of(args)).first()
            return reports.summary_text(args.name, row)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tarnfold").getOrCreate()
    print(run(Engine(spark, args.root, Config()), args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
