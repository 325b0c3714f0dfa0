"""Geostrata: seismic header and trace analytics on Spark DataFrames."""
