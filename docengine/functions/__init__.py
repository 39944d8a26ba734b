"""docengine.functions"""
