"""readloom: sequence-alignment analytics expressed as Spark DataFrame plans."""
