"""python -m ferrule compile RULE.json | execute RULE.json CONTEXT.json [-m sync|async|batch] [-f text|json|csv] [-q]

Exit codes: 0 done, 1 a file is missing, 2 the rule didn't compile or failed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ferrule", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["compile", "execute"])
    p.add_argument("rule")
    p.add_argument("context", nargs="?")
    p.add_argument("-m", "--mode", choices=["sync", "async", "batch"], default="sync")
    p.add_argument("-f", "--format", default="text")
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(argv)
    from ferrule.operators.rules import compile_rule
    from ferrule.report import render

    for path in (a.rule, *([a.context] if a.command == "execute" else [])):
        if not path or not os.path.isfile(path):
            print(f"File not found: {path}", file=sys.stderr)
            return 1
    began = time.perf_counter()
    try:
        with open(a.rule, encoding="utf-8") as f:
            rule = compile_rule(f.read())
        values = {"Rule": rule.name, "Version": rule.rule.version, "Result type": rule.result_type}
        if a.command == "execute":
            from pyspark.sql import SparkSession

            from ferrule.operators.execute import Executor

            with open(a.context, encoding="utf-8") as f:
                record = json.load(f)
            run = Executor(SparkSession.builder.getOrCreate())
            row = run.submit(rule, record, timeout=60).result() if a.mode == "async" else run.execute(rule, record)
            values |= {"Mode": a.mode, "Success": row.success, "Result": row.result, "Error": row.error}
    except Exception as e:  # noqa: BLE001  the command line reports, it doesn't trace
        print(f"Failed: {e}", file=sys.stderr)
        return 2
    values["Milliseconds"] = round((time.perf_counter() - began) * 1000, 3)
    if text := render(a.command, values, a.format, a.quiet):
        print(text)
    return 0 if values.get("Success", True) else 2


if __name__ == "__main__":
    sys.exit(main())
