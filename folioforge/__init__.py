"""folioforge: cleaning, auditing and curating large text collections on Spark."""
