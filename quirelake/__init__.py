"""quirelake: scientific-corpus analytics expressed as Spark DataFrame plans."""
