"""Training-corpus operators: near and exact dedup, archives, quality, chat, decontamination, packing, licences.

Nothing outside this subpackage imports it.
"""
