"""theoremlake: building, searching and analysing corpora of formal declarations on Spark."""
