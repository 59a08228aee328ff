"""lumbra.plans"""
