"""scanloom: Spark operators for code-review data (files, chunks, findings, documents)."""
