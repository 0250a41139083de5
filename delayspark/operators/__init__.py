"""delayspark.operators"""
