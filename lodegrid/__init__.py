"""Rule-scan and finding-triage analytics on Spark DataFrames."""
