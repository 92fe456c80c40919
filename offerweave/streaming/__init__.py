"""offerweave streaming"""
