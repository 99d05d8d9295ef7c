"""findwell.operators"""
