"""The event log as a stream."""

from .events import event_stream, start_status_counts
