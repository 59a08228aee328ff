"""lumbra.sources"""
