"""Spark jobs for network samples and for the text work of a training corpus."""
