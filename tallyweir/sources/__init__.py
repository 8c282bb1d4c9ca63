"""tallyweir.sources"""
