"""Operators for building training corpora, each as a Spark job of its own."""
