"""A Spark-first engine for archives of scanned and otherwise noisy documents."""
