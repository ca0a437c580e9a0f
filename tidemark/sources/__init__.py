"""Sources and sinks: run folders, raw CSV, edges, seeds, state, artifacts."""
