"""attest.operators"""
