"""stepmill.streaming"""
