"""docengine.operators"""
