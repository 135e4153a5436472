"""Alert-triage evaluation as Spark DataFrame operators."""
