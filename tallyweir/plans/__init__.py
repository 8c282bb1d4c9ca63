"""tallyweir.plans"""
