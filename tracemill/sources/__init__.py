from tracemill.sources.buckets import BucketedTrace, write_bucketed
from tracemill.sources.files import parse_lines, read_lines, read_table, read_utilization, table_lines
from tracemill.sources.ledger import LedgerTrace, convert_new, sweep
from tracemill.sources.output import write_csv, write_parquet
from tracemill.sources.schemas import TABLES, Table
from tracemill.sources.trace import CsvTrace, ParquetTrace, SampleTrace, Trace

__all__ = [
    "TABLES", "Table", "Trace", "BucketedTrace", "CsvTrace", "LedgerTrace", "ParquetTrace", "SampleTrace", "convert_new", "sweep", "write_bucketed",
    "parse_lines", "read_lines", "read_table", "read_utilization", "table_lines", "write_csv", "write_parquet",
]
