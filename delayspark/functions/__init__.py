"""delayspark.functions"""
