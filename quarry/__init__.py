"""Quarry: DataFrame operators that build, check and score labelled code and text corpora on Spark."""
