"""Readers and writers."""

from .files import content_hash, file_inventory
from .manifest import parse_kv_manifest, read_manifest_lines, segment_records
from .nested_json import (
    explode_services,
    nested_file_metadata,
    scan_header_array_json,
    header_array_rows,
    scan_json_records,
    scan_nested_json,
)
from .preamble_csv import (
    attach_header,
    file_headers,
    file_metadata,
    scan_csv_records,
    scan_preamble_csv,
    scan_price_csv,
    split_cells,
)
from .sinks import (
    batch_status,
    create_view,
    export_single,
    load_dimension,
    pending_work,
    work_dir,
    write_parquet,
    write_partitioned,
    write_review_csv,
    write_table,
)
from .tables import read_crosswalk, read_parquet_many, require_one

__all__ = [name for name in dir() if not name.startswith("_")]
