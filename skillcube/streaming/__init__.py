"""Verification of forecasts as observations arrive."""
