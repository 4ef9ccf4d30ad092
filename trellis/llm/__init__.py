"""Operators of a training-data pipeline. Nothing else in trellis imports this subpackage."""
