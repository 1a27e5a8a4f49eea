"""Sources and sinks: logs, archives, polling plans."""
