"""stepmill.plans"""
