"""Reading tables, fitted parameters and written features."""

from rowloom.sources.batches import BatchStore
from rowloom.sources.csv import infer_types, read_csv
from rowloom.sources.footers import footer_bounds, stored_bounds
from rowloom.sources.sinks import read_features, save_bucketed, write_features
from rowloom.sources.tables import TABLES, load_tables, store_tables
from rowloom.sources.upsert import PartitionedTable

__all__ = [
    "BatchStore",
    "PartitionedTable",
    "TABLES",
    "footer_bounds",
    "infer_types",
    "load_tables",
    "read_csv",
    "read_features",
    "save_bucketed",
    "store_tables",
    "stored_bounds",
    "write_features",
]
