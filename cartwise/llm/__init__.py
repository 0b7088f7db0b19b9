"""Training-data operators on DataFrames.

One module per operator; ``queries`` registers one query per operator.
Nothing else in the library imports this subpackage.
"""
