"""Receptor specificity clustering expressed as Spark DataFrame plans."""
