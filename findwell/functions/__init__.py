"""findwell.functions"""
