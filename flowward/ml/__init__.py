"""Encoding, scaling, feature selection, training and model-backed scoring on MLlib."""
