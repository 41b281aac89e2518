"""attest.streaming"""
