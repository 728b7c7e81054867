"""opinara.operators"""
