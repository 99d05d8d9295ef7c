"""findwell.sources"""
