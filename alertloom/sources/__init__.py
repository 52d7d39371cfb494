"""Sources and sinks: event tables, flow tables, YAML configs, result writers."""
