"""riskweave.plans"""
