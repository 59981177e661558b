"""Fleet-scale accelerator-profile analytics expressed as Spark DataFrame operators."""
