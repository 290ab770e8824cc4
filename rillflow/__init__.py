"""rillflow: event, retrieval and text-corpus analytics expressed as Spark plans."""
