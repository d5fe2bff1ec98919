"""Whole runs: upload, base and filtered views, findings per slice, narratives, documents and chart data."""
