"""offerweave sources"""
