"""tallyweir.functions"""
