"""vellum: document-digitisation analytics expressed as Spark DataFrame plans."""
