"""attest.plans"""
