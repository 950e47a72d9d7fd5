"""Token-usage and cost analytics over agent logs, as composable Spark DataFrame operators."""
