"""Declarative data pipelines on Spark: YAML configs and a small mapping language compiled to DataFrame plans."""
