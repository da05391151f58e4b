"""tessera: cohort analytics as DataFrame operators on Apache Spark."""
