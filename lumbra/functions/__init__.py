"""lumbra.functions"""
