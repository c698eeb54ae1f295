"""riverlens: inundation analytics as Spark DataFrame, window, ML and streaming plans."""
