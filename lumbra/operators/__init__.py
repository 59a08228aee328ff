"""lumbra.operators"""
