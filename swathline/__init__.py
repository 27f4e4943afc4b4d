"""swathline: gridded Earth-observation analytics expressed as Spark DataFrame plans."""
