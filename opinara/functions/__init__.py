"""opinara.functions"""
