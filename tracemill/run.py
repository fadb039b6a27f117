"""Write named analyses of a trace as CSV: ``python -m tracemill.run --trace DIR --out DIR [--only NAME ...]``.

``--trace`` holds one sub-folder per table with headerless CSV parts, or with Parquet after ``--convert``.
"""

import argparse
from collections.abc import Iterable
from contextlib import nullcontext

from pyspark.sql import SparkSession

from tracemill.operators.cache import cached
from tracemill.plans import machines
from tracemill.plans.catalog import ANALYSES, ATTRIBUTE_ANALYSES, ROW_GRAIN
from tracemill.plans.sharing import used_by_several
from tracemill.sources.buckets import BucketedTrace, write_bucketed
from tracemill.sources.ledger import LedgerTrace, convert_new
from tracemill.sources.output import write_csv
from tracemill.sources.schemas import MACHINE_EVENTS
from tracemill.sources.trace import CsvTrace, ParquetTrace, Trace

HISTORY = "machine_history"


def run(
    trace: Trace,
    out: str,
    names: Iterable[str] | None = None,
    show: int = 0,
    attributes: bool = False,
    machine: int | None = None,
) -> dict[str, str]:
    """Write each analysis to a folder of its name and return the paths; ``show`` prints first rows.

    Without ``names`` all are written, those over machine_attributes only with ``attributes``. With
    ``machine``, the history of that machine as well. What at least two of them use is computed once and kept meanwhile.
    """
    analyses = dict(ANALYSES)
    if machine is not None:
        analyses[HISTORY] = lambda t: machines.machine_history(t.machine_events, machine)
    if names is None:
        names = [name for name in analyses if attributes or name not in ATTRIBUTE_ANALYSES]
    elif machine is not None:
        names = [*names, HISTORY]
    names, paths = list(names), {}
    # One analysis shares nothing, so its plan need not be built beforehand.
    kept = used_by_several(trace.spark, [analyses[name] for name in names]) if len(names) > 1 else set()
    events = cached(trace.machine_events) if MACHINE_EVENTS.name in kept else nullcontext()
    with events, trace.sharing(kept):
        for name in names:
            result = analyses[name](trace)
            if show:
                result.show(show, truncate=False)
            paths[name] = write_csv(result, out, name, one_file=name not in ROW_GRAIN)
    return paths


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--trace", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=("csv", "parquet", "bucketed", "ledger"), default="csv")
    parser.add_argument("--only", nargs="*", choices=sorted(ANALYSES))
    parser.add_argument("--machine", type=int, help="also write the history of this machine")
    parser.add_argument("--attributes", action="store_true", help="also use the lines of machine_attributes")
    parser.add_argument("--show", type=int, default=0)
    parser.add_argument("--convert", action="store_true", help="only write the tables as Parquet to --out")
    parser.add_argument("--by-day", action="store_true", help="with --convert: a sub-folder per day")
    parser.add_argument("--by-machine", action="store_true", help="with --convert: the rows of a machine next to each other")
    parser.add_argument("--buckets", type=int, help="with --convert: task tables in so many buckets by task, to read as bucketed")
    parser.add_argument("--new", action="store_true", help="with --convert: only files that --out has not yet, to read as ledger")
    csv = parser.add_argument_group("CSV only")
    csv.add_argument("--glob", help="names of the part files to read")
    csv.add_argument("--mode", choices=("strict", "lazy", "quarantine"), default="strict", help="what bad lines do")
    csv.add_argument("--presence-flags", action="store_true", help="any text makes a flag true")
    csv.add_argument("--zero-machine-id", action="store_true", help="read a missing machine as 0")
    parquet = parser.add_argument_group("Parquet only")
    parquet.add_argument("--start", type=int, help="first microsecond to read")
    parquet.add_argument("--end", type=int, help="microsecond to stop before")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tracemill").getOrCreate()
    if args.format == "csv":
        trace = CsvTrace(
            spark, args.trace, args.glob, mode=args.mode, presence_flags=args.presence_flags,
            zero_machine_id=args.zero_machine_id,
        )
    else:
        kind = {"parquet": ParquetTrace, "bucketed": BucketedTrace, "ledger": LedgerTrace}[args.format]
        trace = kind(spark, args.trace, args.start, args.end)
    if args.convert and args.new:
        if args.format != "csv":
            parser.error("--new converts CSV")
        read = convert_new(spark, args.trace, args.out, args.glob, by_day=args.by_day, **trace.options)
        print(" ".join(f"{name}={n}" for name, n in read.items()))
    elif args.convert and args.buckets:
        write_bucketed(trace, args.out, args.buckets)
    elif args.convert:
        trace.convert(args.out, args.by_day, args.attributes, args.by_machine)
    else:
        run(trace, args.out, args.only, args.show, args.attributes, args.machine)


if __name__ == "__main__":
    main()
