"""The panel kept up to date from a stream."""
