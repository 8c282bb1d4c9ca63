"""tallyweir.streaming"""
