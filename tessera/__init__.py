"""Media-asset analytics on Spark: asset files, meshes, rasters and their metrics as DataFrames."""
