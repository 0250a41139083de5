"""delayspark.sources"""
