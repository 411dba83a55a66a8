"""Sources and sinks of the index relations."""
