"""Rowloom: contiguous shards, per-shard programs and file-tree inventories on Spark."""

from pyspark import cloudpickle

from rowloom.functions import tasks as _tasks
from rowloom.operators.apply import ShardRun, map_files, map_shards, packed_files, record_files, record_shards
from rowloom.operators.fingerprint import file_digests, fingerprint, fingerprint_tree
from rowloom.operators.hash_tree import changed_ranges, hash_tree
from rowloom.operators.inventory import (
    changed_only,
    exclude_paths,
    file_inventory,
    ignore_patterns,
    inventory_totals,
    pending_outputs,
)
from rowloom.operators.row_index import IndexedScan, with_row_index
from rowloom.operators.split import Shards, split_contiguous
from rowloom.plans.shard_plan import shard_plan
from rowloom.plans.split_file import split_file
from rowloom.sinks import named as _named
from rowloom.sinks.manifest import finished_outputs, read_manifest
from rowloom.sinks.shards import write_csv_records, write_named_shards, write_shards
from rowloom.sinks.tables import write_table
from rowloom.sources.csv import index_csv, parse_records, scan_csv_verbatim
from rowloom.sources.directory import scan_shard_dir
from rowloom.sources.files import list_files
from rowloom.sources.formats import detect_format
from rowloom.sources.parquet import index_parquet, scan_parquet
from rowloom.sources.tables import read_table
from rowloom.sources.text import index_text, scan_text

__all__ = [
    "IndexedScan", "ShardRun", "Shards", "changed_only", "changed_ranges", "detect_format", "exclude_paths", "file_digests",
    "file_inventory", "fingerprint", "finished_outputs", "fingerprint_tree", "hash_tree", "ignore_patterns", "index_csv", "index_parquet",
    "index_text", "inventory_totals", "list_files", "map_files", "map_shards", "packed_files", "parse_records", "pending_outputs",
    "read_manifest", "read_table", "record_files", "record_shards", "scan_csv_verbatim", "scan_parquet", "scan_shard_dir", "scan_text", "shard_plan",
    "split_contiguous", "split_file", "with_row_index", "write_csv_records", "write_named_shards", "write_shards", "write_table",
]

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(_tasks)
cloudpickle.register_pickle_by_value(_named)
