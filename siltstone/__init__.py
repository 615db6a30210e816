"""Search, knowledge and data-processing operators expressed as Spark DataFrame plans."""
