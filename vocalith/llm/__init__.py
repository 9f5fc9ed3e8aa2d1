"""Operators for training data made of transcripts and documents."""
