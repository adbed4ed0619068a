"""Thalweg: raster hydrology and catchment risk on Spark DataFrames."""
