"""Relational operators on meshes, rasters, container chunks, candidates and operation logs."""
