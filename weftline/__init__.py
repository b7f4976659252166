"""Post-training and corpus data operators as Spark DataFrame transformations."""
