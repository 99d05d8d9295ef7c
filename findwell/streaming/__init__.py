"""findwell.streaming"""
