"""theoremlake.streaming"""
