"""Decision trees and random forests on Spark DataFrames, and operators for training-data corpora (``coppice.llm``)."""
