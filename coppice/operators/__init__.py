"""Stages of tree training as operators over DataFrames."""
