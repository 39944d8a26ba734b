"""docengine: financial-document analytics expressed as Spark DataFrame plans."""
