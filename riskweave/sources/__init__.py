"""riskweave.sources"""
