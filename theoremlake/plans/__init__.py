"""theoremlake.plans"""
