"""Readers that turn folders, listings, manifests and notices into DataFrames."""
