"""Review analytics and text-corpus operators as Spark DataFrame transformations."""
