"""riskweave.functions"""
