"""theoremlake.sources"""
