"""offerweave operators"""
