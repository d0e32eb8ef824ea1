"""stepmill.sources"""
