"""Record conformance on Spark: detect, extract, map, validate, score, audit."""

__version__ = "0.1.0"
