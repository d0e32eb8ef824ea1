"""stepmill.functions"""
