"""loomwell: field-level record analytics and corpus preparation, expressed as Spark plans."""
