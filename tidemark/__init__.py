"""tidemark: market-research analytics expressed as Spark DataFrame operators."""
