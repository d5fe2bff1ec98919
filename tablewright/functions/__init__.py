"""Column expressions. Everything here runs inside the JVM; there is no Python UDF."""

from .dates import to_date_time
from .keys import content_key, row_key
from .labels import (
    confidence_label,
    correlation_support,
    readiness_label,
    relationship_strength,
    segment_support,
    correlation_reason,
    segment_reason,
    trend_reason,
    trend_support,
)
from .numbers import display_number, finite, metric_text, percent_text, to_number
from .text import NULL_TOKENS, compare_text, null_tokens_to_null, strip, text_mode, title_case
