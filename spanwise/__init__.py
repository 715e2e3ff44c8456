"""Event and interval analytics for claims-like data as Spark DataFrame operators."""
