"""opinara.plans"""
