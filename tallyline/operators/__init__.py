"""The billing computations, each a function from DataFrames to DataFrames."""
