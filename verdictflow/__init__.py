"""A detection and decisioning engine on Spark: pipelines are declared, compiled to DataFrame
expressions, and give one decision per admitted event."""
