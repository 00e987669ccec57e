from surveyloom.sources.scratch import clear_scratch, scratch_folder, settle, settle_wide
from surveyloom.sources.tables import ingest, ingest_delimited, read_delimited, read_table, write_delimited

__all__ = ["ingest", "ingest_delimited", "read_delimited", "read_table", "clear_scratch", "scratch_folder", "settle", "settle_wide", "write_delimited"]
