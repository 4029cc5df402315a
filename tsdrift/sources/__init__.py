"""Sources and sinks: test tables, raw readings, splits, run logs, models."""
