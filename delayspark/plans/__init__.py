"""delayspark.plans"""
