"""recordspark: record integration and warehouse analytics expressed as Spark plans."""
