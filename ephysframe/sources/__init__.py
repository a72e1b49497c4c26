"""Sources and sinks: Parquet/CSV scans, file listings, snapshot store."""

from ephysframe.sources.readers import (  # noqa: F401
    exists_flag, folder_names, list_entries, list_files, list_folders, parent_folder, read_component, read_csv, read_csv_variants,
    write_bucketed,
)
