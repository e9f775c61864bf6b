"""Command line: ``python -m factloom COMMAND --config FILE... [--data FILE] [--results FOLDER]``."""

from __future__ import annotations

import argparse
import glob
import importlib
import json


def _object(path: str):
    """What ``module:name`` stands for."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom", description="Generate, evaluate and compare runs.")
    p.add_argument("command", choices=("generate", "evaluate", "show", "compare", "bias", "report"))
    p.add_argument("--config", nargs="+", required=True, help="configuration files (patterns as well)")
    p.add_argument("--data", help="the dataset's file")
    p.add_argument("--results", default="results")
    p.add_argument("--out", help="folder of the report")
    p.add_argument("--backend", default="factloom.operators.generate:stub_backend", help="module:function that makes a generation backend")
    p.add_argument("--claims", help="module:function that labels (id, pos, unit, premise) rows")
    p.add_argument("--parent", action="store_true", help="compute PARENT too")
    p.add_argument("--n", type=int, default=10, help="items to show")
    p.add_argument("--n-boot", type=int, default=10_000)
    p.add_argument("--folds", type=int, default=0, help="0: 3 below 400 items, else 5")
    p.add_argument("--seed", type=int, default=13)
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from factloom.operators import evaluate
    from factloom.sources.loaders import load_config

    args = parser().parse_args(argv)
    paths = [p for pattern in args.config for p in (sorted(glob.glob(pattern)) or [pattern])]
    configs = [load_config(p) for p in paths]
    if args.command in ("generate", "evaluate", "show", "bias") and not args.data:
        raise SystemExit(f"{args.command} needs --data")
    spark = SparkSession.builder.getOrCreate()
    if args.command == "compare":
        print("\n".join(evaluate.compare(configs, args.results)))
        return
    if args.command == "report":
        out = args.out or f"{args.results}/battery_report"
        found = evaluate.write_report(spark, configs, args.results, out, args.n_boot, args.folds, args.seed)
        print(f"{found.n_items} paired items; selected: {found.winner}; report in {out}")
        return
    for config in configs:
        if args.command == "generate":
            print(evaluate.run_generation(spark, config, args.data, args.results, _object(args.backend)))
        elif args.command == "evaluate":
            print(json.dumps(evaluate.run_evaluation(spark, config, args.data, args.results, args.parent, _object(args.claims) if args.claims else None), indent=2))
        elif args.command == "show":
            print("\n".join(evaluate.show(spark, config, args.data, args.results, args.n)))
        else:
            print(json.dumps(evaluate.bias(spark, config, args.data, args.results), indent=2))


if __name__ == "__main__":
    main()
