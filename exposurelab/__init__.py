"""exposurelab: how much do posts by one account change what other users write?

Everything here takes DataFrames and column names and gives back DataFrames, so
the same operators run on any timeline of treatments and responses.
"""
