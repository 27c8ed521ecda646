"""loomgrid: deterministic data-processing operators as Spark DataFrame plans."""
