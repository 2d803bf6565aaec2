"""Diffusion-imaging study work as Spark DataFrame operators."""
