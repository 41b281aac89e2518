"""attest.sources"""
