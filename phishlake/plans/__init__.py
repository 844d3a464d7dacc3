"""End-to-end jobs: URL, page, message and combined verdicts."""
