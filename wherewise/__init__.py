"""Set-at-a-time evaluation of spatial referring expressions on Apache Spark."""
