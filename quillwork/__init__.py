"""Study-corpus analytics expressed as Spark DataFrame transformations."""
