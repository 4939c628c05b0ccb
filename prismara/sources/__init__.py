"""Sources and sinks: media listings, metadata chains, result files, caches and masters."""
