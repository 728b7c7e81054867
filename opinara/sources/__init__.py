"""opinara.sources"""
