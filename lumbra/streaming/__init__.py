"""lumbra.streaming"""
