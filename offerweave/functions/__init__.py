"""offerweave functions"""
