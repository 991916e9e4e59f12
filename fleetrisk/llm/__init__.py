"""Training-data operators: chat formatting, decontamination, deduplication, filtering, packing, sharding.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
