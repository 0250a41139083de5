"""delayspark.streaming"""
