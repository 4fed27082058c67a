"""Table and file sources."""

from tidewater.sources.csv_directory import csv_directory, field  # noqa: F401
