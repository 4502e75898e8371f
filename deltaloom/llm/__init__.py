"""Training-data operators: text, token, web-archive and conversation pipelines.

Nothing outside this folder imports it.
"""
