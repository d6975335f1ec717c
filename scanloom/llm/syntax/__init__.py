"""Grammars of six languages, made for checking many files: does a text parse, and if not, where does it belong?"""
