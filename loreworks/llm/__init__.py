"""Operators of a training-data pipeline over document, embedding and conversation tables."""
