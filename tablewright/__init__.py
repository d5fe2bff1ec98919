"""tablewright: tabular data quality, cleaning and signal analysis as Spark jobs."""

from .config import CleaningConfig, ColumnRoles, Preferences
from .operators.cleaning import clean, standardize
from .operators.filters import apply_filters
from .operators.profile import column_types, profile_table
from .plans.runs import base_run, filtered_run, upload_run
from .session import kept_tables, prepare
from .sources.delimited import read_csv

__all__ = [
    "CleaningConfig", "ColumnRoles", "Preferences", "apply_filters", "base_run", "clean", "column_types",
    "filtered_run", "kept_tables", "prepare", "profile_table", "read_csv", "standardize", "upload_run",
]
