"""Operators on cubes: selection, alignment, regions, scores, derived variables, windows, climatologies, regridding."""
