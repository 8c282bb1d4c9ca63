"""tallyweir.operators"""
