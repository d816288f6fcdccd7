"""linkweave: record linkage and text-corpus analytics as composable Spark DataFrame transforms."""
