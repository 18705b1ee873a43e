"""Command line: ``python -m evalframe --task perception --sub-task selection ...``.

Runs :func:`evalframe.plans.evaluate.evaluate` on the current Spark session
(``spark-submit -m evalframe`` or a local session) and prints the scores.
The responder is given as ``module:Class``.
"""

from __future__ import annotations

import argparse
import importlib
import json


def _load(spec: str):
    mod, _, attr = spec.partition(":")
    if not attr:
        raise SystemExit(f"--responder must be module:attribute, got {spec!r}")
    return getattr(importlib.import_module(mod), attr)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="evalframe", description=__doc__.splitlines()[0])
    ap.add_argument("--task", nargs="+", required=True)
    ap.add_argument("--sub-task", nargs="+", required=True)
    ap.add_argument("--lang", required=True, choices=["ja", "en"])
    ap.add_argument("--model-type", required=True, choices=["hf", "vllm", "api"])
    ap.add_argument("--model-name", required=True)
    ap.add_argument("--responder", required=True, help="module:Class building the model client")
    ap.add_argument("--save-dir", required=True)
    ap.add_argument("--data-root", default="data")
    ap.add_argument("--image-dir", default=None)
    ap.add_argument("--family", default=None, help="request profile; default: routed from the model name")
    ap.add_argument("--sub-subtasks", nargs="*", default=None)
    ap.add_argument("--max-parallel", type=int, default=1)
    ap.add_argument("--rename", nargs="*", default=[], metavar="FILE_NAME=COLUMN", help="item columns named otherwise in the files")
    ap.add_argument("--registry", default=None, help="JSON file of registry rows in the order of the registry's columns")
    ap.add_argument("--texts", default=None, help='JSON file {"system_texts": {"task/lang": {...}}, "templates": {...}}')
    ap.add_argument("--resume", action="store_true", help="answer only the items that have no answer yet")
    ap.add_argument("--export-jsonl", action="store_true", help="also write result rows as JSON Lines")
    ap.add_argument("--strict", action="store_true", help="fail on unexpected answer labels")
    args = ap.parse_args(argv)

    from evalframe.plans.evaluate import evaluate
    from evalframe.session import get_session

    registry_rows = None
    if args.registry:
        with open(args.registry, encoding="utf-8") as f:
            registry_rows = [tuple(r) for r in json.load(f)]
    texts: dict = {}
    if args.texts:
        with open(args.texts, encoding="utf-8") as f:
            texts = {kind: {tuple(k.split("/")): v for k, v in by.items()} for kind, by in json.load(f).items()}
    try:
        scores = evaluate(get_session(), args.task, args.sub_task, args.lang, args.model_type, args.model_name,
                          _load(args.responder), args.save_dir, data_root=args.data_root, family=args.family or "route",
                          image_dir=args.image_dir, sub_subtasks=args.sub_subtasks, strict=args.strict,
                          max_parallel=args.max_parallel, resume=args.resume, export_jsonl=args.export_jsonl,
                          rename=dict(r.split("=", 1) for r in args.rename) or None, registry_rows=registry_rows,
                          system_texts=texts.get("system_texts"), templates=texts.get("templates"))
    except ValueError as e:
        raise SystemExit(str(e)) from e
    if scores is not None:
        scores.orderBy("task", "sub_task", "sub_subtask").show(truncate=False)


if __name__ == "__main__":
    main()
