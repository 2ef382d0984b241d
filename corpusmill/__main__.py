"""``python -m corpusmill --dataset_root FOLDER --output FOLDER [...]``: a run of a profile over shards."""

from __future__ import annotations

import argparse
import dataclasses
import importlib

from pyspark.sql import SparkSession

from . import engine


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    p.add_argument("--dataset_root", required=True, help="folder with data-*.arrow")
    p.add_argument("--models", help="module:function that adds the model scores to a table")
    p.add_argument("--image", help="column with images, exported for the rows chosen")
    for f in dataclasses.fields(engine.EngineConfig):
        if f.name == "output":
            p.add_argument("--output", required=True, help="folder for the results, shared by all machines")
        elif f.name == "inspect_only":
            p.add_argument("--inspect_only", action="store_true", help="show structure and examples only")
        elif f.name in ("first", "second"):
            p.add_argument(f"--{f.name}", type=lambda x: tuple(x.split(",")), default=f.default, help="classes that a specialist decides, comma-separated")
        else:
            kind = {"early_presample": int, "limit": int, "seed": int, "target": str}.get(f.name, type(f.default))
            p.add_argument(f"--{f.name}", type=kind, default=f.default)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = vars(arguments(argv))
    folder, named, image = a.pop("dataset_root"), a.pop("models"), a.pop("image")
    models = None
    if named:
        module, _, function = named.partition(":")
        models = getattr(importlib.import_module(module), function)
    spark = SparkSession.builder.appName("corpusmill").getOrCreate()
    rows = engine.load(spark, folder, ",".join(["__key__", "jsonl", *([image] if image else [])]))
    result = engine.run(rows, engine.EngineConfig(**a), models, image)
    for name, table in result.report.items():
        print(f"\n{name}")
        table.show(50, truncate=80)


if __name__ == "__main__":
    main()
