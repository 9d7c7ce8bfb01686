"""Metrics kept up to date as data arrives, by merging stored states."""
