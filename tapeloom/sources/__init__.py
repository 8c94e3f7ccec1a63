"""Readers and writers."""

from tapeloom.sources.tables import clear_work, read_table, work_dir, written

__all__ = ["clear_work", "read_table", "work_dir", "written"]
