"""findwell.plans"""
