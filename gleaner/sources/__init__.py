"""Sources and sinks of reviews."""
