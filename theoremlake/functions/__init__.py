"""theoremlake.functions"""
