"""Survey analytics and data processing as Spark DataFrame transformations."""
