"""stepmill.operators"""
