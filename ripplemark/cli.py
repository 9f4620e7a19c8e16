"""Command line: run INPUT --subject S --session A --session B --task T, or plan with the same arguments. Exit codes: 0 fine, 1 problems, 2 failure."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from ripplemark.plans.settings import STAGES, Settings, settings_from


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ripplemark", description=__doc__)
    p.add_argument("action", choices=("run", "plan"))
    p.add_argument("input_dir")
    for name in ("subject", "task"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--session", action="append", required=True)
    p.add_argument("--modulator", action="append")
    p.add_argument("--skip", action="append", choices=STAGES)
    p.add_argument("--overwrite", action="store_true", default=None)
    p.add_argument("--denoise", action="store_true", default=None)
    for name, kind in (("output-dir", str), ("kernel-method", str), ("kernel-samples", int), ("kernel-seed", int), ("penalty", str), ("percentile", float), ("encoding", str), ("noise", str), ("block-size", int), ("max-features", int)):
        p.add_argument(f"--{name}", type=kind)
    return p


def sessions(args: argparse.Namespace) -> list[Settings]:
    """Settings of each session, sorted; a repeated session is an error."""
    names = sorted(args.session)
    if len(set(names)) != len(names):
        raise ValueError("a session is given twice")
    return [settings_from(vars(args) | {"session": s}) for s in names]


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from ripplemark import workflow
    from ripplemark.session import session

    try:
        wanted = sessions(args)
        spark = session()
        plans = [workflow.dry_run(spark, s) for s in wanted]
        for p in plans:
            print(p.settings.session, "runs:", *p.runs, "stages:", *p.settings.stages())
            for problem in p.problems:
                print("  problem:", problem)
        if any(p.problems for p in plans):
            return 1
        if args.action == "run":
            workflow.run_sessions(spark, wanted)
        return 0
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
