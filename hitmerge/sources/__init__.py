"""Sources and sinks: landed engine responses, result pages, logs, stored reports, reports."""
