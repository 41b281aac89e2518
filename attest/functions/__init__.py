"""attest.functions"""
