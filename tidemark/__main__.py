"""python -m tidemark run|explain MODULE:STEPS [--profile FILE[:NAME]] [--store FOLDER] [--var K=V ...], or python -m tidemark types."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from tidemark.plans import profiles
from tidemark.plans.pipeline import Pipeline, PipelineError
from tidemark.sources.registry import SPECS


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    args.add_argument("command", choices=("run", "explain", "types"))
    args.add_argument("steps", nargs="?", help="a module and the name of its list of steps, as module:name")
    args.add_argument("--profile")
    args.add_argument("--store")
    args.add_argument("--artifacts")
    args.add_argument("--var", action="append", default=[], metavar="K=V")
    a = args.parse_args(argv)
    if a.command == "types":
        print("\n".join(f"{name}: needs {', '.join(' or '.join(g) for g in spec.required) or 'nothing'}" for name, spec in sorted(SPECS.items())))
        return 0
    if not a.steps or ":" not in a.steps:
        args.error("steps are given as module:name")
    module, _, name = a.steps.partition(":")
    steps = getattr(importlib.import_module(module), name)
    path, _, which = (a.profile or "").partition(":")
    profile = profiles.load(path, which or None) if path else {}
    spark = profiles.session(profile)
    run = Pipeline(spark, a.store or profile.get("store"), profile, dict(v.split("=", 1) for v in a.var))
    try:
        print(run.explain(steps) if a.command == "explain" else json.dumps(run.run(steps, a.artifacts).steps, indent=1))
    except PipelineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
