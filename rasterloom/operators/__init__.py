"""Raster operations over DataFrames of pixels: img_id, x, y, width, height, r, g, b, a."""
