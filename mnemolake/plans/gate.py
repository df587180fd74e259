"""The bench of retrieval quality as a command: python -m mnemolake.plans.gate CORPUS [--baseline FILE] [--report FILE].

Exit code 0: measured, nothing worse; 1: a measure fell by more than the epsilon, or the baseline cannot be read; 2: the
call or the corpus is wrong, nothing was measured."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from mnemolake.operators import evaluate, search
from mnemolake.sources import readers


def measured(spark: SparkSession, folder: str) -> dict:
    """The report of a corpus folder (records.jsonl, queries.jsonl)."""
    records, queries = readers.load_corpus(spark, folder)
    index = search.build_index(records, "id", "text")
    began = time.perf_counter()
    per = evaluate.run_baseline(index, queries).persist()
    n = per.count()
    each = (time.perf_counter() - began) * 1000 / max(n, 1)
    return evaluate.report(per, [each] * n)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="gate")
    p.add_argument("corpus")
    p.add_argument("--baseline")
    p.add_argument("--report")
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    if spark is None:
        from mnemolake.session import local_session

        spark = local_session()
    try:
        r = measured(spark, a.corpus)
    except Exception as e:
        print(f"no measure: {str(e)[:300]}", file=sys.stderr)
        return 2
    if a.report:
        readers.write_report(r, a.report)
    print(r)
    return evaluate.gate(r, a.baseline)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
