"""opinara.streaming"""
