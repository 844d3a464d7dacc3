"""Reference lists, feeds, HTML extraction and sinks."""
