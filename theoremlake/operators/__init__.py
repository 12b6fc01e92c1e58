"""theoremlake.operators"""
