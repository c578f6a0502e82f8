"""Command line: mask, demo, rules list|generate, audit. Exit codes: 0 done, 2 wrong input, 1 anything else."""

from __future__ import annotations

import argparse
import json
import os
import sys

VERSION = "0.1.0"


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessera")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("mask", help="mask one file")
    m.add_argument("input")
    m.add_argument("-o", "--output")
    m.add_argument("-r", "--rules")
    m.add_argument("--pepper")
    m.add_argument("--strategy", choices=("mask", "pseudo"), default="mask")
    m.add_argument("--scan-names", action="store_true")
    m.add_argument("--person-list")
    m.add_argument("--encoding", default="utf-8")
    d = sub.add_parser("demo", help="write demonstration data")
    d.add_argument("output")
    d.add_argument("--rows", type=int, default=1000)
    d.add_argument("--seed", type=int, default=42)
    r = sub.add_parser("rules", help="show or generate rules")
    r.add_argument("action", choices=("list", "generate"))
    r.add_argument("request", nargs="?", help="what to mask, in words (generate)")
    r.add_argument("--rules")
    r.add_argument("-i", "--input", help="a document that says what to mask (generate)")
    r.add_argument("-o", "--output", default="rules-generated.yaml")
    r.add_argument("--dry-run", action="store_true", help="show, but write nothing")
    r.add_argument("-y", "--yes", action="store_true", help="write without asking")
    a = sub.add_parser("audit", help="show the last runs")
    a.add_argument("--limit", type=int, default=50)
    return p


def generate(args: argparse.Namespace, ask=None) -> None:
    """Rules from words or a document, by the callable in TESSERA_ASK (module:function) unless one is given. They are
    checked, shown, and written once that is agreed to."""
    from importlib import import_module
    from pathlib import Path

    from .plans.rulesets import generate_rules
    from .sources.documents import units_of

    if bool(args.request) == bool(args.input):
        raise ValueError("say what to mask, either in words or by --input")
    if ask is None:
        module, _, name = os.environ.get("TESSERA_ASK", "").partition(":")
        if not name:
            raise ValueError("no language model is configured: set TESSERA_ASK to module:function")
        ask = getattr(import_module(module), name)
    text = generate_rules(ask, args.request or "\n".join(t for _, t in units_of(args.input, Path(args.input).read_bytes())))
    print(text.strip())
    if args.dry_run:
        return
    if not args.yes and input(f"write {args.output}? [y/N] ").strip().lower() not in ("y", "yes"):
        print("not written")
        return
    Path(args.output).write_text(text, "utf-8")
    print(f"written: {args.output}")


def run(args: argparse.Namespace, ask=None) -> None:
    from .rules import list_rules, load_rules
    from .sources import audit

    if args.command == "rules":
        if args.action == "generate":
            return generate(args, ask)
        for r in list_rules(load_rules(args.rules)):
            print(f"{r['name']}\t{r['version']}\t{r['match']}\t{r['mask']}" + "\t(off)" * r["default_disabled"])
        return
    if args.command == "audit":
        for e in audit.read_log(args.limit):
            print(json.dumps(e, ensure_ascii=False))
        return
    from .plans.files import mask_path, output_path
    from .sources import tables

    if args.command == "demo":
        tables.write_single(tables.demo_data(session(), args.rows, args.seed), args.output, "csv")
        return
    rules = load_rules(args.rules)
    pepper = args.pepper or os.environ.get("TESSERA_PEPPER")
    if not os.path.exists(args.input):
        raise FileNotFoundError(f"no file {args.input}")
    if not pepper and (args.strategy == "pseudo" or any(s.strategy == "pseudo" for s in rules.specs)):
        raise ValueError("a pepper is needed to pseudonymise: --pepper or TESSERA_PEPPER")
    target = args.output or str(output_path(args.input, dotted=True))
    spark = session()
    people = [r.name for r in tables.read_people(spark, args.person_list).collect()] if args.person_list else None
    done = mask_path(spark, args.input, target, rules, pepper, args.strategy, args.scan_names, people, args.encoding)
    audit.log_run(args.input, target, rules, done.rows, pepper)
    print(f"{done.rows} rows, {done.stats.masked} cells changed: {target}")


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
        return 0
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except SystemExit:
        raise
    except Exception as e:
        print(f"failed: {type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
