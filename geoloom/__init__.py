"""Categorical-raster analytics on Spark: cells, regions, chips, blocks and the questions asked of them."""
